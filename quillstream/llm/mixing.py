"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S gets T/S copies: whole ones, and a fraction that is rounded
dependently. Two fractional documents of a source trade mass (words) at random until one is integral, so
that each keeps its expectation and the source keeps its words exactly; what is left of a shard is one
fractional document, and those meet again in a reduction tree until one per source is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

#: Documents of a leaf, and fractional documents of an inner node of the reduction tree.
LEAF, FAN_IN = 512, 64
#: Up to so many sources have their targets set on the driver; more stay in a table.
DRIVER_SOURCES = 100_000
CAP = 3
_EPS = 1e-9


def weights_of(n: int) -> list[int]:
    """1, 2, 3, repeating."""
    return [1 + k % 3 for k in range(n)]


def targets(sizes: list[int], weights: list[int], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; a source stops at cap times its size, the excess is shared again by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        stopped = set(over)
        open_ = [i for i in open_ if i not in stopped]
    return out


def pivot(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Rounds the fractions p to 0 or 1 but for at most one, which stays as it is; if last, it is drawn by itself.

    Documents come largest first. Each pair trades words: one gains d words and the other loses d, with d and the
    direction drawn such that both keep their expectation, until one of them is 0 or 1.
    """
    out, u, carry = p.copy(), rng.random(len(p)), -1
    for j in np.argsort(-size, kind="stable"):
        if out[j] < _EPS or out[j] > 1 - _EPS:
            out[j] = round(out[j])
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        a, b, si, sj = out[i], out[j], size[i], size[j]
        up, down = min((1 - a) * si, b * sj), min(a * si, (1 - b) * sj)  # words to i, words from i
        d = up if u[j] * (up + down) < down else -down
        a, b = a + d / si, b - d / sj
        a, b = (round(a) if a < _EPS or a > 1 - _EPS else a), (round(b) if b < _EPS or b > 1 - _EPS else b)
        out[i], out[j] = a, b
        carry = i if 0 < a < 1 else j if 0 < b < 1 else -1
    if carry >= 0 and last:
        out[carry] = float(rng.random() < out[carry])
    return out


_KEY = "doc_id, key, occ"
_SCHEMA = "doc_id long, key long, occ int, source string, size long, whole int, p double, node long, leaves long"


def _node(seed: int):
    def f(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "key", "occ"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        first = pdf.iloc[0]
        rng = np.random.default_rng([seed, int(first["key"]) & 0xFFFFFFFF, len(pdf), int(first["leaves"])])
        pdf["p"] = pivot(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float), rng, bool(first["leaves"] <= 1))
        return pdf

    return f


def source_targets(thin: DataFrame, cap: float = CAP) -> DataFrame:
    """source, source_size, n, target; sources by code point, null last."""
    found = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rows = [tuple(r) for r in found.limit(DRIVER_SOURCES + 1).collect()]
    if len(rows) > DRIVER_SOURCES:
        return _targets_by_table(found, cap)
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    goal = targets([r[1] for r in rows], weights_of(len(rows)), cap)
    return thin.sparkSession.createDataFrame([(*r, t) for r, t in zip(rows, goal)], "source string, source_size long, n long, target double")


def _targets_by_table(found: DataFrame, cap: float) -> DataFrame:
    """The same shares for any number of sources: ranks by a sorted table, then rounds of sums until no more source stops."""
    parts = F.spark_partition_id().alias("part")
    order = F.col("source").asc_nulls_last()
    ranged = durable(found.repartitionByRange(order).sortWithinPartitions(order).select("*", parts, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, first = 0, {}
    for part, k in sorted(map(tuple, ranged.groupBy("part").agg(F.count(F.lit(1))).collect())):
        first[part], before = before, before + k
    offset = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])[F.col("part")]
    ranked = ranged.select("source", "source_size", "n", (F.pmod(offset + F.col("at"), F.lit(3)) + 1).cast("double").alias("w"))
    words = ranked.where("source_size > 0")
    total, rate, stopped = words.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.lit(rate) * F.col("w") > cap * F.col("source_size")
        s = words.agg(F.count_if(over).alias("k"), F.sum(F.when(over, cap * F.col("source_size")).otherwise(0.0)).alias("gone"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if s.k in (stopped, None) or not s.w:
            break
        stopped, rate = s.k, (total - s.gone) / s.w
    target = F.when(F.col("source_size") > 0, F.least(F.lit(rate) * F.col("w"), cap * F.col("source_size").cast("double"))).otherwise(0.0)
    return durable(ranked.select("source", "source_size", "n", target.alias("target")))


def _sent(goals: DataFrame) -> DataFrame:
    """Targets by source, marked for broadcast where they are few."""
    return F.broadcast(goals) if goals.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES else goals


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = CAP, seed: int = 7) -> DataFrame:
    """doc_id, key, occ, source, size, source_size, target, copies: whole copies of each row of `docs`.

    size counts words; null and empty texts have none and get no copies. A null source is a source of its own,
    last in order. Copies never exceed `cap`. Repeated rows are told apart by occ (0, 1, ...) within equal
    (doc_id, key), key being a hash of text and source. Reruns agree: shards and random numbers depend on
    ids, sizes and the seed alone, not on partitions. Empty table: empty result. Other columns are ignored.

    The shuffle carries no text. Leaves hold about LEAF documents whatever the source's share, inner nodes
    FAN_IN residuals, so a hot source only has more leaves.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text_col), F.col(source_col)).alias("key"))
    # repeated rows are counted before they move, and dealt out again
    same = thin.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("times"))
    thin = durable(same.select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(0), F.col("times").cast("int") - 1)).alias("occ")))
    goals = source_targets(thin, cap)
    sent = _sent(goals)
    joined = thin.join(sent.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    x = F.when(F.abs(x - F.round(x)) < _EPS, F.round(x)).otherwise(x)
    leaves = F.ceil(F.col("n") / LEAF)
    level = joined.select(
        "doc_id", "key", "occ", "source", "size", F.when(F.col("size") > 0, F.floor(x)).otherwise(0).cast("int").alias("whole"),
        F.when(F.col("size") > 0, x - F.floor(x)).otherwise(0.0).alias("p"), F.pmod(F.xxhash64("key", "doc_id", "occ"), leaves).alias("node"), leaves.alias("leaves"),
    )
    done, depth = None, 0
    most = max(1, -(-(goals.agg(F.max("n")).first()[0] or 0) // LEAF))
    while True:
        level = durable(level.groupBy("source", "node").applyInPandas(_node(seed + depth), _SCHEMA))
        whole = level.where("p = 0 or p = 1")
        done = whole if done is None else done.unionByName(whole)
        if most <= 1:
            break
        up = lambda c: F.ceil(F.col(c) / FAN_IN)
        level = level.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN)).withColumn("leaves", up("leaves"))
        most, depth = -(-most // FAN_IN), depth + 1
    out = done.select("doc_id", "key", "occ", "source", "size", (F.col("whole") + F.col("p").cast("int")).cast("long").alias("copies"))
    return out.join(sent.drop("n").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each repeated as often as the mix takes it (not at all for 0), columns unchanged.

    Rows without a word are never taken. Repeated rows have copies of their own. Empty table: empty result. Columns may have any name.
    """
    text, source = options.get("text_col", "text"), options.get("source_col", "source")
    plan = mix_copies(docs, **options).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("occ").alias("__o"), "copies")
    keyed = docs.withColumn("__key", F.xxhash64(F.col(text), F.col(source))).withColumn("__doc", F.col(options.get("id_col", "doc_id")).cast("long"))
    keyed = keyed.withColumn("__occ", (F.row_number().over(Window.partitionBy("__doc", "__key").orderBy(F.lit(1))) - 1).cast("int"))
    plan = plan.withColumnRenamed("copies", "__copies")
    met = keyed.join(plan, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")) & (F.col("__occ") == F.col("__o")))
    return met.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document; nulls, empties and repeats as in mix_copies."""
    out = mix_copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
