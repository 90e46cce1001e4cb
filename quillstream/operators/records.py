"""Keyed tables: last wins, upserts, diffs, resume anti-joins, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def upsert(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """base with rows of equal key replaced, and new keys added; both sides have one row per key, keys not null."""
    marked = base.withColumn("__src", F.lit(0)).unionByName(changes.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    return pick(marked, key, [F.desc("__src")]).drop("__src")


def update_fields(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Field by field: a change's non-null fields win, missing rows are added."""
    joined = base.alias("b").join(changes.alias("c"), key, "full")
    cols = [F.coalesce(f"c.{c}", f"b.{c}").alias(c) if c in changes.columns else F.col(f"b.{c}") for c in base.columns if c not in key]
    return joined.select(*key, *cols)


def nested_upsert(array: Column, item: Column, field: str) -> Column:
    """Replaces the array's struct of equal `field`, else appends the item; a null array is empty."""
    array = F.coalesce(array, F.slice(F.array(item), 1, 0))
    there = F.exists(array, lambda x: x[field] == item[field])
    return F.when(there, F.transform(array, lambda x: F.when(x[field] == item[field], item).otherwise(x))).otherwise(F.concat(array, F.array(item)))


def diff(current: DataFrame, previous: DataFrame, key: list[str], column: str, clear: list[str]) -> DataFrame:
    """current with `clear` emptied where `column` differs from the previous snapshot (null-safe); new keys stay."""
    old = previous.select(*key, F.col(column).alias("__old"), F.lit(True).alias("__there"))
    joined = current.join(old, key, "left")
    changed = F.col("__there") & ~F.col(column).eqNullSafe(F.col("__old"))
    for c in clear:
        joined = joined.withColumn(c, F.when(changed, F.lit("")).otherwise(F.col(c)))
    return joined.withColumn("changed", F.coalesce(changed, F.lit(False))).drop("__old", "__there")


def pending(source: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    return source.join(done.select(*key).distinct(), key, "left_anti")


def backfill(frames: DataFrame, slots: DataFrame, key: str, slot: str, n: int) -> DataFrame:
    """(key, slot) of slots 1..n that are missing."""
    wanted = frames.select(key).distinct().withColumn(slot, F.explode(F.sequence(F.lit(1), F.lit(n))))
    return wanted.join(slots.select(key, slot).distinct(), [key, slot], "left_anti")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (least node): each round takes the least label around and then jumps to that label's label.

    edges: src, dst. State is written to the checkpoint folder each round, so lineage stays short.
    """
    from .shared import durable

    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = durable(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = durable(new.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
        if new.join(labels.toDF("node", "before"), "node").where("component <> before").isEmpty():
            return new
        labels = new
