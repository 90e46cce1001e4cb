"""Best-fit packing: pattern packing by non-negative least squares.

Patterns of a few lengths that fill a sequence are enumerated, their repeat counts are fitted to the length
histogram by non-negative least squares, rounded down, and what is left is packed best-fit-decreasing on the
histogram. The histogram has one entry per length, so the plan's size doesn't depend on the documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, durable, table, trim
from .tokens import END_ID, encoder

CAPACITY = 1024
#: Pieces of one rank shard, about.
SHARD = 20_000
#: Repeats of one piece that stay together, at most.
LOT = 5_000
#: Ways to round the fitted repeats: share of them that is rounded down, and from which fraction on a pattern has one more (0: none).
ROUNDINGS = ((1.0, 0.3), (1.0, 0.6), (1.0, 0.0), (0.9, 0.0), (0.75, 0.0), (0.5, 0.0), (0.25, 0.0), (0.0, 0.0))
#: Lengths that patterns are made of, at most: the most frequent ones. Pieces of other lengths are packed best-fit.
MOST_LENGTHS = 2_048

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(capacity: int, tokenizer: str | None):
    end = struct.pack("<I", END_ID)

    def run(it):
        enc = encoder(tokenizer)

        def f(cols):
            out = {n: [] for n in _PIECES.names}
            for doc, ids in zip(cols["doc_id"].to_pylist(), enc.encode(cols["text"].to_pylist())):
                ids += end
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = capacity if n <= capacity or start else n % capacity or capacity
                    length = min(length, n - start)
                    for name, v in zip(_PIECES.names, (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))):
                        out[name].append(v)
                    start, piece = start + length, piece + 1
            return out

        yield from batches(it, _PIECES, f)
        enc.forget()
        trim()

    return run


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each document with its end id; of a longer one, the first may be shorter.

    Null and empty texts are one piece, their end id. Repeated rows and rows without an id have their pieces each. Other
    columns are ignored. Empty table: empty result.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(capacity, tokenizer), _PIECES_DDL)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of one to three of `lengths` that sum to `capacity`, as rows padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = capacity - a - b
    ok = (a <= b) & (b <= c)
    three = np.stack([a, b, c], 1)[ok & there[np.clip(c, 0, capacity)]]
    two = np.stack([lengths, capacity - lengths, 0 * lengths], 1)[(lengths <= capacity - lengths) & there[np.clip(capacity - lengths, 0, capacity)]]
    one = np.array([[capacity, 0, 0]])[: int(there[capacity])]
    return np.concatenate([one, two, three]).astype(np.int64)


def fit(rows: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares |A x - hist| by multiplicative updates, A being the patterns' length counts."""
    n = len(hist)
    count = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), n)

    def back(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        v[0] = 0
        return v[rows].sum(1)

    h = hist.astype(float)
    goal = back(h)
    x = goal / np.maximum(1.0, back(count(np.ones(len(rows)))))
    for _ in range(steps):
        y = count(x)
        y[0] = 0
        x *= goal / np.maximum(back(y), 1e-12)
    return x


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, repeats), such that every piece of the histogram has exactly one place.

    The fitted repeats are rounded in several ways: down from all of them or from a part, with or without the patterns whose fraction
    is large. What a rounding leaves is packed best-fit, and the rounding with the fewest sequences is taken.
    """
    lengths = np.flatnonzero(hist)
    lengths = lengths[lengths > 0]
    rows = patterns(np.sort(lengths[np.argsort(-hist[lengths], kind="stable")[:MOST_LENGTHS]]), capacity)
    x = fit(rows, hist) if len(rows) else np.empty(0)
    order, by_fraction = np.argsort(-x, kind="stable"), np.argsort(-(x % 1), kind="stable")
    best, fewest = None, None
    for part, fraction in ROUNDINGS:
        out, left = _rounded(rows, x * part, order, by_fraction if fraction else by_fraction[:0], hist, fraction)
        out += best_fit(left, capacity)
        n = sum(m for _, m in out)
        if best is None or n < fewest:
            best, fewest = out, n
    return best


def _rounded(rows: np.ndarray, x: np.ndarray, order: np.ndarray, by_fraction: np.ndarray, hist: np.ndarray, fraction: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(patterns and their whole repeats, what is left of the histogram)."""
    left, out = hist.astype(np.int64).copy(), []
    for k in order:
        if x[k] < 1 and np.count_nonzero(rows[k]) > 1:
            continue
        r = [int(v) for v in rows[k] if v]
        most = min(int(left[v]) // r.count(v) for v in r)
        m = min(int(x[k]), most) if len(r) > 1 else most
        if m > 0:
            out.append((tuple(sorted(r, reverse=True)), m))
            for v in r:
                left[v] -= m
    for k in by_fraction:  # what rounding left, while it still fits exactly
        r = [int(v) for v in rows[k] if v]
        if x[k] % 1 < fraction:
            break
        if all(left[v] >= r.count(v) for v in r):
            out.append((tuple(sorted(r, reverse=True)), 1))
            for v in r:
                left[v] -= 1
    return out, left


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, all sequences of one content at a time."""
    classes: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by free places
    open_ = np.zeros(capacity + 1, bool)
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            free = np.flatnonzero(open_[v:])
            if len(free):
                space = v + int(free[0])
                content, have = classes[space].popitem()
                m = min(have, n)
                if have > m:
                    classes[space][content] = have - m
            else:
                space, content, m = capacity, (), -(-n // (capacity // v)) if capacity // v > 1 else n
                m = max(1, min(m, n))
            open_[space] = bool(classes[space])
            new = (*content, v)
            classes[space - v][new] = classes[space - v].get(new, 0) + m
            open_[space - v] = True
            n -= m
    return [(content, m) for by in classes for content, m in by.items()]


def places(made: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: rank >= first -> sequence = base + rank - first, at offset."""
    runs, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for content, m in made:
        at = 0
        for v in content:
            runs.append((v, used[v], base, at))
            used[v] += m
            at += v
        base += m
    a = np.array(runs, np.int64).reshape(-1, 4)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    return {"length": a[:, 0], "first": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset; lengths are 1 to capacity, each sequence is filled from 0 without gaps.

    Pieces of a length take that length's places by rank. Ranks come from shards of about SHARD pieces (a hash of all that is
    known of the piece). Repeated pieces are counted before they move and dealt to the shards in lots of LOT, so that neither a
    length nor one piece that makes any share of the rows, such as that of rows without id and text, fills a task; they have a place each.
    Null doc_ids are packed like others. Empty table: empty result.
    """
    spark = pieces.sparkSession
    cols = pieces.columns
    pieces = durable(pieces.groupBy(*cols).agg(F.count(F.lit(1)).alias("__times")))
    n = pieces.agg(F.sum("__times")).first()[0] or 0
    shards = max(1, -(-n // SHARD))
    lots = pieces.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("__times") - 1, F.lit(LOT)))))
    lots = lots.withColumn("__n", F.least(F.lit(LOT).cast("long"), F.col("__times") - F.col("__lot") * LOT)).drop("__times")
    sharded = lots.withColumn("__shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", "__lot"), F.lit(shards)))
    counts = durable(sharded.groupBy("length", "__shard").agg(F.sum("__n").alias("__n")))
    hist = np.zeros(capacity + 1, np.int64)
    for length, k in counts.groupBy("length").agg(F.sum("__n")).collect():
        hist[length] = k
    runs = spark.sparkContext.broadcast(places(plan(hist, capacity), capacity))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("length").alias("__l"), F.col("__shard").alias("__s"), before.alias("__before"))
    own = Window.partitionBy("length", "__shard").orderBy("doc_id", "piece", "start", "ids_crc32", "__lot").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sharded.withColumn("__first", F.coalesce(F.sum("__n").over(own), F.lit(0))).join(offsets, (F.col("length") == F.col("__l")) & (F.col("__shard") == F.col("__s")))
    ranked = ranked.withColumn("__rank", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__n") - 1)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = runs.value
        wide = np.int64(1) << np.int64(50)
        k = np.searchsorted(r["length"] * wide + r["first"], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": r["base"][k] + rank.to_numpy() - r["first"][k], "offset": r["offset"][k]})

    return ranked.withColumn("__at", place("length", F.col("__rank") + F.col("__before"))).select(*cols, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; null texts are empty and have their end id only."""
    return pack(token_pieces(docs, capacity, tokenizer, id_col, text_col), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and places of every document; nulls, empties and repeats as in token_pieces and pack."""
    return pack_documents(table(spark, sf_dir, "documents"))
