"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, table

#: A group of more rows is hot: its rows get their group from a broadcast table. Where that could be more than MOST_HOT groups, hot ones are
#: those with more than 1 / MOST_HOT of the rows, which can't be more; the others are too small to fill a task.
HOT, MOST_HOT = 1_000, 100_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Texts are equal when identical after lower-casing A-Z. The aggregation's key is (128-bit hash, text):
    rows meet by hash and are then compared byte for byte, so colliding texts stay apart, and copies
    collapse on the map side, so a group may hold any share of the rows. Rows that repeat both id and text are
    counted before they move and dealt out again at the end. Groups of two or more come back to their rows by narrow
    keys: those of hot groups meet a broadcast table and are dealt by id, the others meet in a shuffle.

    keep: "smallest" or "largest" id. A null text counts as empty. A null id never wins over another id.
    Rows that repeat both id and text: exactly one of them is kept. Empty table: empty result. Other
    columns of `docs` are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    keyed = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    groups = (
        keyed.groupBy("h", "norm")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = durable(groups)
    rows = keyed.groupBy("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha")).agg(F.count(F.lit(1)).alias("times"))
    limit = max(HOT, (groups.agg(F.sum("group_size")).first()[0] or 0) // max(MOST_HOT, 1))
    hot = groups.where(F.col("group_size") > limit)
    if not hot.isEmpty():
        met = rows.join(F.broadcast(hot.withColumnRenamed("sha", "hot_sha")), F.col("sha") == F.col("hot_sha"), "left").withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})
        # rows of hot groups are dealt by a key that no group has
        met = met.withColumn("key", F.when(F.col("hot_sha").isNull(), F.col("sha")).otherwise(F.unhex(F.md5(F.concat_ws(" ", F.lit("hot"), "doc_id")))))
        cold = groups.where(F.col("group_size") <= limit).withColumnRenamed("sha", "key")
        met = met.join(cold, "key", "left").withColumn("keep_id", F.when(F.col("hot_sha").isNull(), F.col("keep_id")).otherwise(F.col("hot_id"))).withColumn("group_size", F.coalesce("hot_size", "group_size"))
    else:
        met = rows.join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    wins = alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return met.select("doc_id", "sha", "keep_id", "group_size", wins.alias("wins"), alone.alias("alone"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")).select(
        "doc_id",
        F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("wins") & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, all their columns unchanged, whatever their names.

    Null and empty texts are equal texts. Of rows that repeat both id and text any one stays. Empty table: empty result.
    """
    stays = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = docs.withColumn("__sha", F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).withColumn("__id", F.col(id_col))
    mine = keyed.alias("a").join(stays.alias("b"), F.col("a.__id").eqNullSafe(F.col("b.__id")) & (F.col("a.__sha") == F.col("b.__sha")), "left_semi")
    once = F.row_number().over(Window.partitionBy("__id", "__sha").orderBy(F.lit(1)))
    return mine.withColumn("__n", once).where("__n = 1").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and verdict of every document, the largest id staying; nulls, empties and repeats as in exact_groups."""
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
