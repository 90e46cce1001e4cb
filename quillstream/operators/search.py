"""Lexical and vector retrieval, rank fusion, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, RRF = 1.2, 0.75, 60


def bm25(docs: DataFrame, query: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of documents with a query term.

    Only a text's length and its query terms leave the scan; they are written to the checkpoint folder once, and both the
    corpus statistics and the term counts read them there, so that every text is cut into tokens once.
    """
    from .shared import durable

    terms = sorted(set(query))
    toks = durable(docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t")).select("id", F.size("t").alias("n"), F.filter("t", lambda x: x.isin(*terms)).alias("t")))
    stats = toks.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("avg_n"))
    tf = toks.select("id", "n", F.explode("t").alias("term")).groupBy("id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("avg_n")))
    # df has at most one row per query term, stats exactly one
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cosine with the query vector (0 for zero vectors, null for null ones): an exact scan, no shuffle."""
    length = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    q, v = F.array(*[F.lit(float(x) / length) for x in query]), F.col(vector_col)
    own = F.sqrt(dot(v, v))
    return vectors.select(F.col(id_col).alias("id"), F.round(F.when(own > 0, dot(v, q) / own).otherwise(F.when(v.isNotNull(), 0.0)), 9).alias("score"))


def top(scored: DataFrame, n: int) -> DataFrame:
    """The n best with rank 1.. by (score desc, id)."""
    best = scored.orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int, depth: int | None = None) -> DataFrame:
    """id, rrf, n_modes, confidence: reciprocal-rank fusion of the two lists' first `depth` (4 * limit, at least 20)."""
    depth = depth or max(4 * limit, 20)
    both = top(lexical, depth).select("id", F.col("rank").alias("lex"), F.lit(None).cast("double").alias("cos"), "rank").unionByName(
        top(semantic, depth).select("id", F.lit(None).cast("int").alias("lex"), F.col("score").alias("cos"), "rank")
    )
    fused = both.groupBy("id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("rrf"), F.count(F.lit(1)).alias("n_modes"), F.max("lex").alias("lex"), F.max("cos").alias("cos"))
    confidence = 0.72 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("cos", F.lit(0.0)))) + F.when(F.col("n_modes") == 2, 0.14).otherwise(0.0) + F.coalesce(0.10 / F.col("lex"), F.lit(0.0))
    return fused.select("id", "rrf", "n_modes", F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.05), confidence)), 6).alias("confidence")).orderBy(F.desc("rrf"), "id").limit(limit)


def coverage(text: Column, query: list[str]) -> Column:
    """(distinct query tokens that the lower-cased text contains)² / tokens; 0 without tokens."""
    terms = sorted(set(query))
    if not terms:
        return F.lit(0.0)
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.round(hits * hits / F.lit(float(len(terms))), 6)


def specificity(source_hits: Column, description_hits: Column, name_hits: Column, citations: Column) -> Column:
    """Entity score, damped by the square root of its citations."""
    return (source_hits + 2 * description_hits + 3 * name_hits) / F.greatest(F.lit(1.0), F.sqrt(citations))


#: Vectors of a block, about: two blocks meet in one task.
BLOCK = 512


def similar_pairs(vectors: DataFrame, id_col: str, vec_col: str, least: float) -> DataFrame:
    """src, dst (src < dst) of all pairs of vectors whose dot product is `least` or more: an exact scan, block by block."""
    import numpy as np

    e = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = -(-e.count() // BLOCK) or 1
    own = e.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def meet(key: tuple, pdf):
        import pandas as pd

        ids, v = pdf["id"].to_numpy(), np.stack(pdf["v"].to_numpy())
        a, b = (pdf["own"].to_numpy() == k for k in key)
        x, y = np.nonzero(v[a] @ v[b].T >= least)
        pairs = pd.DataFrame({"src": ids[a][x], "dst": ids[b][y]})
        if key[0] != key[1]:
            pairs = pd.DataFrame({"src": pairs.min(axis=1), "dst": pairs.max(axis=1)})
        return pairs[pairs["src"] < pairs["dst"]]

    return own.groupBy(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).applyInPandas(meet, "src long, dst long")


#: Vectors of a packed block; parts that blocks are dealt to, as long as a part has no more than HELD of them.
PACKED, PARTS, HELD = 1024, 16, 64


def packed(vectors: DataFrame, n: int) -> DataFrame:
    """block, ids, vectors: the n vectors (id, v: an array of doubles) in blocks of PACKED, as bytes, stored. All have one length, else this raises."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from .shared import durable

    kinds = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])
    size, parts = PACKED, max(min(PARTS, -(-n // PACKED)), -(-n // (HELD * PACKED)), 1)

    def pack(it):
        block, held, dims = TaskContext.get().partitionId() << 32, [], None
        for b in it:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                lengths = np.unique(part.column(1).value_lengths().to_numpy(zero_copy_only=False))
                dims = int(lengths[0]) if dims is None else dims
                if len(lengths) != 1 or lengths[0] != dims:
                    raise ValueError(f"vectors of {lengths.min()} to {max(lengths.max(), dims)} components")
                held.append((part.column(0).to_numpy(), flat.reshape(-1, dims)))
                while sum(len(x[0]) for x in held) >= size:
                    ids, v = (np.concatenate(x) for x in zip(*held))
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids[:size].tobytes()], pa.binary()), pa.array([v[:size].tobytes()], pa.binary())], schema=kinds)
                    block, held = block + 1, [(ids[size:], v[size:])]
        if sum(len(x[0]) for x in held):
            ids, v = (np.concatenate(x) for x in zip(*held))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], schema=kinds)

    return durable(vectors.select("id", "v").repartition(parts, "id").mapInArrow(pack, "block long, ids binary, vectors binary"))


def linking_pairs(vectors: DataFrame, id_col: str, vec_col: str, least: float) -> DataFrame:
    """src, dst (src < dst) that connect the same vectors as all pairs whose dot product is `least` or more, but only few of them.

    Every pair is compared, block by block, but for blocks whose vectors are connected already. A task keeps its vectors' least labels and
    tells one pair for each that has another one, so what is written is at most PARTS times twice the number of vectors as long as a part
    holds HELD blocks. Stored blocks meet without a shuffle; the work is that of all pairs, quadratic by nature.
    """
    import numpy as np
    import pyarrow as pa

    e = vectors.where(F.size(vec_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    own = packed(e, e.count())

    def merge(label, x, y):
        while True:
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                return label
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]

    def link(it):
        at, ids, label = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in it:
            for row in range(batch.num_rows):
                lo, i, v, hi, j, w = (c[row].as_py() for c in batch.columns)
                for k, x in ((lo, i), (hi, j)):
                    if k not in at:
                        x = np.frombuffer(x, np.int64)
                        at[k] = (len(ids), len(ids) + len(x))
                        ids, label = np.concatenate([ids, x]), np.concatenate([label, np.arange(*at[k])])
                (a, b), (c, d) = at[lo], at[hi]
                if (label[a:b] == label[a]).all() and (label[c:d] == label[a]).all():
                    continue
                x, y = np.nonzero(np.frombuffer(v).reshape(b - a, -1) @ np.frombuffer(w).reshape(d - c, -1).T >= least)
                label = merge(label, x + a, y + c)
        one, two = ids, ids[label]
        ok = one != two
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)[ok]), pa.array(np.maximum(one, two)[ok])], names=["src", "dst"])

    other = own.toDF("other", "__ids", "__vectors").hint("shuffle_replicate_nl")
    return own.join(other, F.col("block") <= F.col("other")).mapInArrow(link, "src long, dst long")
