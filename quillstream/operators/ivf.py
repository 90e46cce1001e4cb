"""An inverted-file index of vectors: lists around centroids, probes, exact re-rank, and the number of probes from measured recall.

Centroids are fitted on a bounded sample; every vector is in a list. Lists are stored in blocks of BLOCK vectors, so a list of any
size is many rows. A question reads the blocks of its nearest lists and computes exact cosines there.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, lists at most, vectors of a block, questions of a block, questions that recall is measured on.
SAMPLE, LISTS, BLOCK, ASKED, MEASURED = 50_000, 4096, 1024, 256, 200
#: Scored rows that a task holds before it tells its best.
KEPT = 1 << 21


def fitted(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit centroids of the sample's unit vectors, by spherical k-means; as many as there are distinct vectors, at most."""
    sample = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), min(lists, len(sample)), replace=False))]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def _unit(col: pa.Array, dims: int) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_BLOCKS = pa.schema([("list", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("n", pa.int32())])
_BLOCKS_DDL = "list int, ids binary, vectors binary, n int"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v of rows with an id and a vector that isn't null, empty or zero, and whose components are all finite numbers."""
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    thin = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return thin.where("id is not null and v is not null").where(F.coalesce(good, F.lit(False)))


def build(rows: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None) -> np.ndarray:
    """Writes the lists of all usable vectors under `path`, and gives the centroids. Vectors have one length, else this raises.

    lists: twice the root of the number of vectors, LISTS at most. The sample is the SAMPLE vectors of least hash, so reruns agree.
    """
    thin = usable(rows, id_col, vector_col)
    spark = thin.sparkSession
    n, low, high = thin.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return np.zeros((0, 0))
    if low != high:
        raise ValueError(f"vectors of {low} to {high} components")
    sample = np.array([r.v for r in thin.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()])
    c = fitted(sample / np.linalg.norm(sample, axis=1, keepdims=True), lists or min(LISTS, max(1, int(2 * n**0.5))))
    sent = spark.sparkContext.broadcast(c)  # LISTS * components at most

    def pack(it):
        held: dict[int, list] = {}

        def out(k):
            ids, v = (np.concatenate(x) for x in zip(*held.pop(k)))
            return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([len(ids)], pa.int32())], schema=_BLOCKS)

        for b in it:
            v, ids = _unit(b.column(1), high), b.column(0).to_numpy()
            own = (v @ sent.value.T).argmax(1)
            for k in np.unique(own).tolist():
                at = np.flatnonzero(own == k)
                for piece in range(0, len(at), BLOCK):
                    held.setdefault(k, []).append((ids[at[piece : piece + BLOCK]], v[at[piece : piece + BLOCK]]))
                    if sum(len(x[0]) for x in held[k]) >= BLOCK:
                        yield out(k)
        for k in list(held):
            yield out(k)

    thin.mapInArrow(pack, _BLOCKS_DDL).repartitionByRange("list").sortWithinPartitions("list").write.parquet(path)
    sent.unpersist()
    return c


def neighbors(spark: SparkSession, path: str, centroids: np.ndarray, asked: DataFrame, k: int, probes: int) -> DataFrame:
    """question, id, score, rank: each question's k best by cosine among the vectors of its `probes` nearest lists, itself left out by id.

    asked: id, v. Questions meet lists in blocks, never one by one; ties go to the smaller id.
    """
    sent, dims, probes = spark.sparkContext.broadcast(centroids), centroids.shape[1] if len(centroids) else 0, min(probes, len(centroids))
    empty = "question long, id long, score double"
    if not probes:
        return _best(spark.createDataFrame([], empty), k)

    def probe(it):
        schema = pa.schema([("near", pa.int32()), ("who", pa.binary()), ("q", pa.binary())])
        for b in it:
            for at in range(0, b.num_rows, ASKED):
                part = b.slice(at, ASKED)
                v, ids = _unit(part.column(1), dims), part.column(0).to_numpy()
                near = np.argpartition(-(v @ sent.value.T), probes - 1, axis=1)[:, :probes]
                for j in np.unique(near).tolist():
                    mine = np.flatnonzero((near == j).any(1))
                    yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([ids[mine].tobytes()], pa.binary()), pa.array([v[mine].tobytes()], pa.binary())], schema=schema)

    def score(it):
        best = _Best(k)
        for b in it:
            for row in range(b.num_rows):
                ids, x, who, q = (np.frombuffer(b.column(j)[row].as_py(), t) for j, t in enumerate((np.int64, float, np.int64, float)))
                yield from best.add(who, ids, q.reshape(-1, dims) @ x.reshape(-1, dims).T)
        yield from best.rest()

    wanted = asked.select("id", "v").mapInArrow(probe, "near int, who binary, q binary")
    pairs = spark.read.schema(_BLOCKS_DDL).parquet(path).join(wanted, F.col("list") == F.col("near")).select("ids", "vectors", "who", "q")
    return _best(pairs.mapInArrow(score, empty), k)


class _Best:
    """The k best of each question by score, then id, of what a task has met so far; what is held beyond KEPT rows goes out."""

    def __init__(self, k: int):
        self.k, self.new, self.n = k, [], 0

    def add(self, who: np.ndarray, ids: np.ndarray, s: np.ndarray):
        s = np.round(s, 9)
        s[who[:, None] == ids[None, :]] = -np.inf
        # those that are not below a question's k-th score here, ties included
        least = np.partition(s, -self.k, axis=1)[:, -self.k][:, None] if len(ids) > self.k else -np.inf
        at, of = np.nonzero((s >= least) & (s > -np.inf))
        self.new.append((who[at], ids[of], s[at, of]))
        self.n += len(at)
        if self.n > KEPT:
            self.cut()
            if self.n > KEPT // 2:
                yield from self.rest()

    def cut(self) -> None:
        who, ids, s = (np.concatenate(x) for x in zip(*self.new))
        order = np.lexsort((ids, -s, who))
        who = who[order]
        first = np.maximum.accumulate(np.where(np.r_[True, who[1:] != who[:-1]], np.arange(len(who)), 0))
        order = order[np.arange(len(who)) - first < self.k]
        self.new, self.n = [tuple(c[order] for c in (np.concatenate(x) for x in zip(*self.new)))], len(order)

    def rest(self):
        if self.n:
            self.cut()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self.new[0]], names=["question", "id", "score"])
        self.new, self.n = [], 0


def exact_neighbors(spark: SparkSession, path: str, asked: DataFrame, k: int) -> DataFrame:
    """question, id, score, rank: each question's k best by cosine among all stored vectors, itself left out by id. asked: id, v.

    The work is that of all pairs. Packed questions meet the stored blocks without a shuffle, and a task tells only its own k best.
    """
    from ..sources.jsonl import exists
    from .search import packed

    empty = "question long, id long, score double"
    if not exists(spark, path):  # nothing usable was there to be stored
        return _best(spark.createDataFrame([], empty), k)

    def score(it):
        best = _Best(k)
        for b in it:
            for row in range(b.num_rows):
                ids, x, who, q = (np.frombuffer(b.column(j)[row].as_py(), t) for j, t in enumerate((np.int64, float, np.int64, float)))
                q = q.reshape(len(who), -1)
                yield from best.add(who, ids, (q / np.linalg.norm(q, axis=1, keepdims=True)) @ x.reshape(len(ids), -1).T)
        yield from best.rest()

    questions = packed(asked, asked.count()).select(F.col("ids").alias("who"), F.col("vectors").alias("q")).hint("shuffle_replicate_nl")
    blocks = spark.read.schema(_BLOCKS_DDL).parquet(path).select("ids", "vectors")
    return _best(blocks.join(questions).mapInArrow(score, empty), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """question, hits, wanted: how many of its exact neighbours each question has found."""
    there = found.select(F.col("question").alias("q"), F.col("id").alias("i"))
    met = exact.join(there, (F.col("question") == F.col("q")) & (F.col("id") == F.col("i")), "left")
    return met.groupBy("question").agg(F.count("q").alias("hits"), F.count(F.lit(1)).alias("wanted"))


def calibrated(spark: SparkSession, path: str, centroids: np.ndarray, asked: DataFrame, k: int, target: float = 0.95) -> int:
    """The number of probes (1, 2, 4, ..., all) whose measured recall reaches the target on MEASURED of the questions, those of least hash."""
    from .shared import durable

    some = durable(asked.orderBy(F.xxhash64("id"), "id").limit(MEASURED))
    exact = durable(exact_neighbors(spark, path, some, k))
    probes = 1
    while probes < len(centroids):
        hits, wanted = recall(neighbors(spark, path, centroids, some, k, probes), exact).agg(F.sum("hits"), F.sum("wanted")).first()
        if (hits or 0) >= target * (wanted or 0):
            break
        probes *= 2
    return min(probes, len(centroids))


def index_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    from .shared import shared_folder

    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
