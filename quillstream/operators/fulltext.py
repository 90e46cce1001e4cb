"""A stored full-text index: postings by term and document range with block maxima, and exact top-k by block-max pruning.

Documents are dealt to ranges of WIDTH. A block holds a term's postings in one range, as places in the range and counts, so it is bounded
however frequent the term, and knows the postings of which one can add most to a score. Ids and lengths stand once for a range. Questions, many at once, first sum those maxima by range; the
most promising ranges are scored, and then only ranges that may still beat a question's k-th best score are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import B, K1

#: Documents of a range.
WIDTH = 1024
#: Ranges that a question scores before it knows a bound.
SEEDS = 2
#: Questions that meet a range in one task; rows of which a task cuts the words at once, and their bytes, about.
LOT, ROWS, BYTES = 4096, 256, 4 << 20
#: Rows of terms or ranges up to which blocks are picked without a shuffle.
FEW = 200_000
_SLACK = 1e-6
_INK = np.zeros(256, bool)
_INK[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


_LISTS = {"at": pa.int32(), "tfs": pa.int32(), "top_tfs": pa.int32(), "top_ns": pa.int32(), "ids": pa.int64(), "ns": pa.int32()}
_BLOCKS = pa.schema([("term", pa.string()), ("range", pa.int64()), ("df", pa.int64()), *((k, pa.list_(x)) for k, x in _LISTS.items())])
_BLOCKS_DDL = "term string, range long, df long, at array<int>, tfs array<int>, top_tfs array<int>, top_ns array<int>, ids array<long>, ns array<int>"


def _counted(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of lower-cased texts; (row, number of the term, count) of each text's terms; words of each text. A term is a run of a-z and 0-9."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    ink = np.append(_INK[data], False)
    before = np.append(False, ink[:-1])
    before[offsets] = False
    after = np.append(ink[1:], False)
    after[offsets[offsets > 0] - 1] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(row, minlength=len(col)).astype(np.int32)
    if not len(starts):
        return pa.array([], pa.string()), row, row, row, words
    # words and what is between them take turns as values of one column
    both = np.stack([starts, ends], 1).ravel()
    turns = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = turns.take(pa.array(np.arange(0, len(both) - 1, 2))).dictionary_encode()
    size = len(coded.dictionary)
    cells, tfs = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), cells // size, cells % size, tfs, words


def _invert(width: int):
    """Blocks of a task's documents, a range of `width` at a time, in the order of the terms; a row without a term holds a range's ids and lengths.

    A posting that has no larger count than a shorter document of its block can't add most, whatever the average length: the others are the block's tops.
    """

    def block(number: int, held: list) -> pa.RecordBatch:
        ids, words = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[5] for x in held])
        first = np.cumsum([0, *(len(x[0]) for x in held)])
        coded = pa.concat_arrays([x[1] for x in held]).dictionary_encode()
        n = len(coded.dictionary)
        sorted_ = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(n, np.int64)
        rank[sorted_] = np.arange(n)
        of, base = rank[coded.indices.to_numpy()], np.cumsum([0, *(len(x[1]) for x in held)])
        term = np.concatenate([of[b + x[3]] for x, b in zip(held, base)])
        row = np.concatenate([x[2] + f for x, f in zip(held, first)])
        tfs = np.concatenate([x[4] for x in held]).astype(np.int64)
        order = np.lexsort((row, term))
        best = np.lexsort((-tfs, words[row], term))
        most = np.maximum.accumulate(term[best] << 32 | tfs[best])
        tops = best[np.append(True, most[1:] > most[:-1])[: len(best)]]
        ends, top_ends = (np.append(np.searchsorted(x, np.arange(n + 1)), len(x)) for x in (term[order], term[tops]))
        one = np.append(np.zeros(n + 1, np.int64), len(words))
        cells = {"at": (ends, row[order]), "tfs": (ends, tfs[order]), "top_tfs": (top_ends, tfs[tops]), "top_ns": (top_ends, words[row[tops]]), "ids": (one, ids), "ns": (one, words)}
        lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(x, _LISTS[k])) for k, (e, x) in cells.items()]
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(sorted_)), pa.array([None], pa.string())])
        return pa.RecordBatch.from_arrays([terms, pa.array(np.full(n + 1, number), pa.int64()), pa.array(np.diff(ends), pa.int64()), *lists], schema=_BLOCKS)

    def run(it):
        number, seen, held = TaskContext.get().partitionId() << 32, 0, []
        for b in it:
            at = 0
            while at < b.num_rows:
                most = min(ROWS, width - seen, b.num_rows - at)
                while most > 1 and b.slice(at, most).nbytes > BYTES:
                    most //= 2
                part = b.slice(at, most)
                held.append((part.column(0), *_counted(part.column(1))))
                at, seen = at + most, seen + most
                if seen == width:
                    yield block(number, held)
                    number, seen, held = number + 1, 0, []
        if held:
            yield block(number, held)

    return run


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> None:
    """Writes the index of `docs` under `path`: postings in blocks, with the ranges' documents, terms, stats.

    Null texts have no terms, but count as documents. Rows without an id and repeated rows are documents of their own. Tasks count
    terms and put blocks together range by range; blocks stay where they were made,
    so that only counts of terms are shuffled.
    """
    spark = docs.sparkSession
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(F.col(text_col)).alias("t"))
    thin.mapInArrow(_invert(width), _BLOCKS_DDL).write.parquet(f"{path}/postings")
    lengths = _blocks(spark, path).where("term is null").select(F.explode("ns").alias("n"))
    lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_n")).coalesce(1).write.parquet(f"{path}/stats")
    _blocks(spark, path).where("term is not null").groupBy("term").agg(F.sum("df").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS_DDL).parquet(f"{path}/postings")


def _stats(spark: SparkSession, path: str) -> tuple[int, float]:
    """Documents, and their average length."""
    row = spark.read.parquet(f"{path}/stats").first()
    return row.docs, row.avg_n or 1.0


def _part(tf, n, avg: float):
    """What a posting adds to a score, without its term's weight: columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / avg))


def _few(df: DataFrame) -> DataFrame:
    """A frame of short rows, sent to all tasks if there are FEW at most."""
    return F.broadcast(df) if df.count() <= FEW else df


def bounds(spark: SparkSession, path: str, questions: DataFrame) -> DataFrame:
    """question, term, idf, range, most: what a term can add to a question's score in a range. questions: question, terms (an array).

    Postings themselves aren't read. Terms that no document has, and null or empty term lists, add nothing.
    """
    from .shared import durable

    asked = questions.select("question", F.explode(F.array_distinct("terms")).alias("term"))
    n, avg = _stats(spark, path)
    top = F.transform(F.arrays_zip("top_tfs", "top_ns"), lambda x: _part(x["top_tfs"], x["top_ns"], F.lit(avg)))
    terms, df = _few(durable(asked.select("term").distinct())), F.col("df")
    known = spark.read.parquet(f"{path}/terms").join(terms, "term", "left_semi").select("term", F.ln(1 + (F.lit(n) - df + 0.5) / (df + 0.5)).alias("idf"))
    own = _blocks(spark, path).join(terms, "term", "left_semi").select("term", "range", F.array_max(top).alias("best"))
    blocks = asked.join(known, "term").join(own, "term")
    return blocks.select("question", "term", "idf", "range", (F.col("idf") * F.col("best")).alias("most"))


def _scored(spark: SparkSession, path: str, wanted: DataFrame, keep: int) -> DataFrame:
    """question, id, score of the `keep` best of the wanted blocks (question, term, idf, range).

    A range's blocks meet LOT questions, about, in one task, whoever asks for them; only a question's best of a range leave it. Only blocks
    of terms that are asked for are shuffled, once. Of many blocks some may come that no question of the lot wants in that range; they are passed over.
    """
    from .shared import durable

    wanted = durable(wanted)
    lots = -(-wanted.select("question").distinct().count() // LOT) or 1
    wanted = wanted.withColumn("lot", F.pmod(F.xxhash64("question"), F.lit(lots)))
    every, avg = _blocks(spark, path).select("term", "range", "at", "tfs", "ids", "ns"), _stats(spark, path)[1]
    pairs = durable(wanted.select("range", "lot").distinct())
    needed = durable(wanted.select("term", "range", "lot").distinct())
    if needed.count() <= FEW:
        blocks = every.join(F.broadcast(needed), ["term", "range"])
    else:
        blocks = every.join(_few(durable(wanted.select("term").distinct())), "term", "left_semi").join(_few(pairs), "range")
    own_docs = every.where("term is null").join(_few(pairs), "range")
    blocks = blocks.select(*(x := ("term", F.col("range").alias("r"), "at", "tfs", "ids", "ns", F.col("lot").alias("l")))).unionByName(own_docs.select(*x))
    kind = spark.createDataFrame([], wanted.select("question").schema).withColumns({"id": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}).schema

    def score(own: pa.Table, asked: pa.Table) -> pa.Table:
        lists = {k: own[k].combine_chunks() for k in ("at", "tfs", "ids", "ns")}
        at, tfs, ns = (lists[k].flatten().to_numpy() for k in ("at", "tfs", "ns"))
        ids, ends, part = lists["ids"].flatten(), np.cumsum([0, *lists["at"].value_lengths().to_pylist()]), _part(tfs, ns[at], avg)
        places = {t: slice(a, b) for t, a, b in zip(own["term"].to_pylist(), ends, ends[1:])}
        coded, sums, whose, found, scores = asked["question"].combine_chunks().dictionary_encode(null_encoding="encode"), np.zeros(len(ns)), [], [], []
        of, terms, idfs = coded.indices.to_numpy(), asked["term"].to_pylist(), asked["idf"].to_numpy()
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
            sums[:] = 0
            for k in rows:
                s = places[terms[k]]
                sums[at[s]] += idfs[k] * part[s]
            best = np.flatnonzero(sums)
            if len(best) > keep:  # scores that may be equal after rounding stay
                best = best[sums[best] >= np.partition(sums[best], -keep)[-keep] - 1e-8]
            whose.append(np.full(len(best), of[rows[0]]))
            found.append(best)
            scores.append(sums[best])
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
        return pa.table({"question": coded.dictionary.take(pa.array(join(whose, np.int64))), "id": ids.take(pa.array(join(found, np.int64))), "score": pa.array(join(scores, float))})

    each = blocks.groupBy("r", "l").cogroup(wanted.groupBy("range", "lot")).applyInArrow(score, kind)
    return _best(each.withColumn("score", F.round("score", 9)), keep)


def _best(scored: DataFrame, keep: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def search(spark: SparkSession, path: str, questions: DataFrame, k: int, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """(question, id, score, rank of each question's k best documents, blocks that were read: question, term, idf, range).

    Exact: the same as scoring every document, ties by the smaller id. Documents without a term of the question aren't found.
    """
    from .shared import durable

    every = durable(bounds(spark, path, questions))
    ranges = durable(every.groupBy("question", "range").agg(F.sum("most").alias("most")))
    first = _best(ranges.select("question", F.col("range").alias("id"), F.col("most").alias("score")), seeds).select("question", F.col("id").alias("range"))
    seed = every.join(first, ["question", "range"], "left_semi")
    found = durable(_scored(spark, path, seed.select("question", "term", "idf", "range"), k))
    least = found.where(F.col("rank") == k).select(F.col("question").alias("q"), F.col("score").alias("least"))
    open_ = ranges.join(first, ["question", "range"], "left_anti").join(least, F.col("question") == F.col("q"), "left").where(F.col("least").isNull() | (F.col("most") >= F.col("least") - _SLACK))
    rest = every.join(open_.select("question", "range"), ["question", "range"], "left_semi").select("question", "term", "idf", "range")
    both = _scored(spark, path, rest, k).unionByName(found).drop("rank")
    return _best(both, k), seed.select("question", "term", "idf", "range").unionByName(rest)
