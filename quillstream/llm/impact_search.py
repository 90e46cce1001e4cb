"""Exact top-k search over an impact-ordered index, score at a time.

The index keeps blocks of vectors. A block's posting lists are its dimensions: places ordered by falling component, in
segments of one quantised impact each. A query takes a list from its head where its own component is positive, from its tail
where it is negative, and processes all lists together, segments of the greatest contribution first. What a vector hasn't met yet can't
contribute more than the current level, so accumulated upper bounds say who may still be among the best; the query stops when
the bound of everyone else is below the k-th best exact score so far, and rescores the possible members exactly.

Queries are a stated set of rows. They are taken from the index and sent to the blocks in slices of a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, trim

#: Vectors of a block; queries that are sent to the tasks at once; components are quantised to steps of 2^SHIFT.
BLOCK, SLICE, SHIFT = 8192, 1 << 16, 4
#: Scaled components go up to here, so that scores fit 64 bits.
WIDEST = 1 << 28
#: Shares of the greatest contribution at which a query looks whether it may stop; there it does if at most FEW of a block are possible members.
LEVELS, FEW = (0.25, 0.0), 0.02

_BLOCKS = pa.schema([("block", pa.int64()), ("size", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("known", pa.binary()), ("queries", pa.binary()), ("vectors", pa.binary()), ("order", pa.binary())])
_BLOCKS_DDL = "block long, size int, dims int, ids binary, known binary, queries binary, vectors binary, order binary"


def _build(it):
    """Blocks of vectors of one length, with their lists."""
    k, base = 0, TaskContext.get().partitionId() << 32
    held: dict[int, list] = {}

    def out(dims: int):
        nonlocal k
        ids, known, asks, x = (np.concatenate([h[j] for h in held[dims]]) for j in range(4))
        held[dims] = []
        for at in range(0, len(ids), BLOCK):
            part = slice(at, at + BLOCK)
            v = x[part]
            order = np.argsort(-v, axis=0, kind="stable").T.astype(np.int16)
            cells = [[base + k], [len(v)], [dims], [ids[part].tobytes()], [known[part].tobytes()], [asks[part].tobytes()], [v.tobytes()], [np.ascontiguousarray(order).tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _BLOCKS)], schema=_BLOCKS)
            k += 1

    for b in it:
        lists = b.column(2)
        size = np.diff(lists.offsets.to_numpy())
        values = lists.values.to_numpy(zero_copy_only=False).reshape(-1)
        first = lists.offsets.to_numpy()[:-1]
        ids, known = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_valid().to_numpy(zero_copy_only=False)
        asks = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for dims in np.unique(size).tolist():
            at = np.flatnonzero(size == dims)
            x = values[first[at][:, None] + np.arange(dims)].astype(np.int32)
            held.setdefault(dims, []).append((ids[at], known[at], asks[at], x))
            if sum(len(h[0]) for h in held[dims]) >= BLOCK:
                yield from out(dims)
    for dims in held:
        if held[dims]:
            yield from out(dims)
    trim()


def impact_index(rows: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Blocks of floor(scale * component), in the shared folder. `asks` marks the rows that are queries too.

    Vectors that are null, empty or hold a null, a component that isn't finite or one beyond WIDEST are left out. A null id asks nothing.
    """
    x = F.transform(F.col(vector_col), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    good = F.forall(F.col(vector_col), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < WIDEST))
    thin = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.coalesce(good, F.lit(False)))
    thin = thin.select(F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), x.alias("x"))
    return stored(thin.mapInArrow(_build, _BLOCKS_DDL))


class Block:
    """A block of the index as arrays. starts[j, l]: how many places of list j have a quantised impact of edges[l] or more."""

    def __init__(self, row: dict):
        n, d = row["size"], row["dims"]
        self.number, self.ids, self.known = row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(n, d).astype(np.int64)
        self.order = np.frombuffer(row["order"], np.int16).reshape(d, n).astype(np.int64)
        self.levels = np.take_along_axis(self.vectors.T, self.order, 1) >> SHIFT
        self.far = int(np.abs(self.vectors).max())
        edges = np.unique(self.levels)  # segments of the lists
        self.edges = edges
        self.starts = np.stack([n - np.searchsorted(self.levels[j, ::-1], edges) for j in range(d)])  # places at or above each edge
        self.floor = (self.levels << SHIFT).astype(float)
        self.ceil = self.floor + (1 << SHIFT) - 1

    def heads(self, q: np.ndarray, tau: float) -> np.ndarray:
        """How far each list, from the end where it contributes most, has contributions that may reach tau."""
        n, step = len(self.ids), (1 << SHIFT) - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            level = np.where(q > 0, np.ceil((tau / q - step) / (1 << SHIFT)), np.floor(tau / q / (1 << SHIFT)))
        low = np.searchsorted(self.edges, np.nan_to_num(level), side="left")
        high = np.searchsorted(self.edges, np.nan_to_num(level), side="right")
        j = np.arange(len(q))
        at = np.concatenate([self.starts, np.zeros((len(q), 1), self.starts.dtype)], 1)
        return np.where(q > 0, at[j, low], np.where(q < 0, n - at[j, high], 0))

    def best(self, q: np.ndarray, k: int, least: float, own: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the block's k best with a score of `least` or more, smaller ids first among equals; postings processed."""
        n = len(self.ids)
        upper, done = np.zeros(n), np.zeros(len(q), np.int64)
        greatest, work = float(np.abs(q).max()) * self.far, 0
        slack = 1e-9 * len(q) * greatest
        possible = np.arange(n)
        for share in LEVELS if greatest else ():
            tau = share * greatest
            upto = self.heads(q, tau)
            for j in np.flatnonzero(upto > done):
                part = slice(done[j], upto[j]) if q[j] > 0 else slice(n - upto[j], n - done[j])
                upper[self.order[j, part]] += q[j] * (self.ceil if q[j] > 0 else self.floor)[j, part]
                work += upto[j] - done[j]
            done = np.maximum(done, upto)
            # what a list can still add: the contribution at its head, below the level in any case
            rest = np.zeros(n)
            if tau:
                next_ = [0.0 if m == n or not c else c * (self.ceil[j, m] if c > 0 else self.floor[j, n - 1 - m]) for j, (m, c) in enumerate(zip(done, q))]
                cap = np.minimum(tau, next_)
                rest += cap.sum()
                for j in np.flatnonzero((cap != 0) & (done > 0)):
                    rest[self.order[j, : done[j]] if q[j] > 0 else self.order[j, n - done[j] :]] -= cap[j]
            bound = upper + rest + slack
            if own is not None:
                bound[own] = -np.inf
            tops = np.argpartition(-bound, min(2 * k, n) - 1)[: 2 * k]
            tops = tops[bound[tops] > -np.inf]
            if len(tops) >= k:
                least = max(least, int(np.partition(self.vectors[tops] @ q, len(tops) - k)[len(tops) - k]))
            possible = np.flatnonzero(bound >= least)
            if len(possible) <= FEW * n:
                break
        if own is not None:
            possible = possible[possible != own]
        score = self.vectors[possible] @ q
        some = np.flatnonzero(score >= least)
        at, score = possible[some], score[some]
        first = np.lexsort((self.ids[at], ~self.known[at], -score))[:k]
        return at[first], score[first], work


def _search(asked, k: int):
    schema = pa.schema([("query_block", pa.int64()), ("query_place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("postings", pa.int64())])

    def run(it):
        queries = asked.value
        least: list = [-np.inf] * len(queries)  # the k-th best score of each query that this task has seen: exact, so no float
        tops = [np.empty(0, np.int64)] * len(queries)
        for batch in it:
            for row in range(batch.num_rows):
                block = Block({f.name: c[row].as_py() for f, c in zip(batch.schema, batch.columns)})
                out = [[] for _ in schema]
                for i, (number, place, query_id, q) in enumerate(queries):
                    if len(q) != block.vectors.shape[1]:
                        continue
                    at, score, work = block.best(q, k, least[i], place if number == block.number else None)
                    tops[i] = np.sort(np.append(tops[i], score))[-k:]
                    least[i] = int(tops[i][0]) if len(tops[i]) == k else -np.inf
                    ids = [x if ok else None for x, ok in zip(block.ids[at].tolist(), block.known[at].tolist())]
                    for column, v in zip(out, ([number] * len(at), [place] * len(at), [query_id] * len(at), ids, score.tolist(), [work] * len(at))):
                        column += v
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
        trim()

    return run


def _queries(it):
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("vector", pa.binary())])
    for batch in it:
        for row in range(batch.num_rows):
            number, dims, ids, asks, vectors = (batch.column(k)[row].as_py() for k in range(5))
            at = np.flatnonzero(np.frombuffer(asks, bool))
            v = np.frombuffer(vectors, np.int32).reshape(-1, dims)[at].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(np.frombuffer(ids, np.int64)[at]), pa.array([x.tobytes() for x in v], pa.binary())], schema=schema)


def search(index: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for every query of the index its k highest inner products with other rows, smaller ids first.

    All, where there are fewer. A query's own row is left out by its place, so rows that share an id meet each other, and each row that
    asks has its own k rows. Rows without an id come last among equals. Vectors of another length don't meet. No queries: empty result.
    """
    spark = index.sparkSession
    asked = stored(index.select("block", "dims", "ids", "queries", "vectors").mapInArrow(_queries, "block long, place int, id long, vector binary"))
    slices = max(1, -(-asked.count() // SLICE))
    found = None
    for s in range(slices):
        rows = asked.where(F.pmod(F.xxhash64("block", "place"), F.lit(slices)) == s).collect()
        sent = spark.sparkContext.broadcast([(r.block, r.place, r.id, np.frombuffer(r.vector, np.int64)) for r in rows])
        part = index.mapInArrow(_search(sent, k), "query_block long, query_place int, query_id long, vec_id long, score long, postings long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_block", "query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every vec_id divisible by 50 among all other vectors; nulls, ties and repeats as in impact_index and search."""
    return search(impact_index(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.row AS q_row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row <> q.row AND len(c.x) = len(q.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
