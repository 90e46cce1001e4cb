"""Changes of keyed tables: merges of fields, first writers, imports, templates, overrides, key-value and graph upserts, retries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records


def merge_nested(array: Column, item: Column, key: str, fields: list[str]) -> Column:
    """The array with the struct of equal key updated field by field (fields that are null in the item stay), else the item appended."""
    array = F.coalesce(array, F.slice(F.array(item), 1, 0))
    merged = F.transform(array, lambda x: F.when(x[key].eqNullSafe(item[key]), F.struct(*[F.coalesce(item[f], x[f]).alias(f) for f in fields])).otherwise(x))
    return F.when(F.exists(array, lambda x: x[key].eqNullSafe(item[key])), merged).otherwise(F.concat(array, F.array(item)))


def union_first(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the first frame, and those of the second whose key the first doesn't have; columns may be missing on either side."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def set_columns(rows: DataFrame, values: dict) -> DataFrame:
    """rows with columns set to one value each, whether they were there or not."""
    return rows.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in values.items()})


def clear_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns emptied: "" for texts, null for others; columns that aren't there stay out."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: F.lit("") if kinds[c] == "string" else F.lit(None).cast(kinds[c]) for c in columns if c in kinds})


def update_both(scenes: DataFrame, chapters: DataFrame, changes: DataFrame, key: str, array: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(scenes, chapters) after changes to scenes' fields: standalone rows and the copies in the chapters' arrays alike.

    changes: key and fields, one row a key. Arrays that hold a changed key are unfolded, changed by join and folded again in their
    order, each distinct one once; chapters meet theirs by its value, so no row needs a number. Null and empty arrays stay. Chapters are
    stored first: arrays that were collected from a shuffle may come in another order when they are computed again, and would miss theirs.
    """
    from .shared import durable

    chapters = durable(chapters)
    new = changes.select(F.col(key).alias("__k"), F.struct(*fields).alias("__new"))
    put = {f: F.when(F.col("__k").isNotNull(), F.col(f"__new.{f}")).otherwise(F.col(f)) for f in fields}
    own = scenes.join(new, F.col(key) == F.col("__k"), "left").withColumns(put).drop("__k", "__new")
    names = [f.name for f in chapters.schema[array].dataType.elementType.fields]
    arrays = chapters.select(F.col(array).alias("__old")).where(F.size("__old") > 0).distinct()
    flat = arrays.select("__old", F.posexplode("__old").alias("__pos", "__x")).select("__old", "__pos", "__x.*").join(new, F.col(key) == F.col("__k"), "left").withColumns(put)
    folded = flat.groupBy("__old").agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.struct(*names).alias("v")))), lambda x: x["v"]).alias("__new"))
    whole = chapters.join(folded, F.col(array) == F.col("__old"), "left").withColumn(array, F.coalesce("__new", array)).select(*chapters.columns)
    return own, whole


def import_results(current: DataFrame, prior: DataFrame, key: list[str], keep: Column, columns: dict[str, Column], order: list) -> DataFrame:
    """current, and of the prior results those that `keep` names, in the shape of `columns`, whose key isn't there yet.

    Of prior results that share a key, the first in `order` (columns of the prior results) is taken.
    """
    shaped = records.pick(prior.where(keep), key, order).withColumns(columns)
    return current.unionByName(shaped.join(current.select(*key).distinct(), key, "left_anti").select(*[c for c in shaped.columns if c in current.columns]), allowMissingColumns=True)


def from_template(rows: DataFrame, key: list[str], slot: str, n: int, order: list[str], overrides: dict[str, Column]) -> DataFrame:
    """A row for each missing slot 1..n of a key: a copy of the key's first row in order, with overrides (they may use the slot)."""
    first = records.pick(rows, key, order).drop(slot)
    wanted = first.select(*key).withColumn(slot, F.explode(F.sequence(F.lit(1), F.lit(n))))
    missing = wanted.join(rows.select(*key, slot).distinct(), [*key, slot], "left_anti")
    return missing.join(first, key).withColumns(overrides).select(*rows.columns)


def rebuild(table: DataFrame, derived: Column, fresh: DataFrame) -> DataFrame:
    """table with its derived rows replaced by fresh ones."""
    return table.where(~F.coalesce(derived, F.lit(False))).unionByName(fresh, allowMissingColumns=True)


def override(rows: DataFrame, key: str, column: str, forced: dict[str, str], excluded: list[str]) -> DataFrame:
    """rows without the excluded keys, and with forced values of the column where there are any."""
    kept = rows.where(~F.coalesce(F.col(key), F.lit("")).isin(*excluded)) if excluded else rows
    if not forced:
        return kept
    known = F.create_map(*[F.lit(x) for kv in forced.items() for x in kv])
    return kept.withColumn(column, F.coalesce(F.element_at(known, F.col(key)), F.col(column)))


def inject(rows: DataFrame, extra: DataFrame, identity: list[str], valid: Column, order: list) -> DataFrame:
    """rows with those extra ones that are valid and whose identity is new; of extra rows that share one, the first in order."""
    return union_first(rows, records.pick(extra.where(valid), identity, order), identity)


def distinct_targets(rows: DataFrame, name: str, source: str, order: list[str], unknown: list[str]) -> DataFrame:
    """The first row of each name in order; rows of unknown names are distinct by their source."""
    low = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    nameless = low.isin("", *unknown)
    keyed = rows.withColumn("__target", F.when(nameless, F.concat(F.lit("?"), F.col(source).cast("string"))).otherwise(low))
    return records.pick(keyed, ["__target"], order).drop("__target")


def put(store: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """A key-value store (namespace, key, version, value) after the entries; of several for one key the last in order."""
    last = records.pick(entries, ["namespace", "key", "version"], [F.col(c).desc() for c in order]).select("namespace", "key", "version", "value")
    return records.upsert(store, last, ["namespace", "key", "version"])


def merge_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after a merge: nodes by id, the new values winning field by field; edges (src, dst, kind) once
    each, and only between nodes that are there."""
    all_nodes = records.update_fields(nodes, new_nodes, ["id"])
    ends = all_nodes.select(F.col("id"))
    all_edges = edges.unionByName(new_edges).dropDuplicates(["src", "dst", "kind"])
    return all_nodes, all_edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind")


def alias_components(rows: DataFrame, name: str, aliases: str, key: Callable[[Column], Column], forced: dict[str, str]) -> DataFrame:
    """key, canonical: names that share a row are one entity; its canonical spelling is forced where exactly one spelling is
    forced among its keys, else the most frequent, then the longest, then the greatest.

    rows: name and an array of aliases. A row's first key with a forced spelling drops those of its names that are forced otherwise.
    """
    known = F.create_map(*[F.lit(x) for kv in forced.items() for x in kv]) if forced else None
    of = lambda k: F.element_at(known, k) if known is not None else F.lit(None).cast("string")
    named = rows.where(key(F.col(name)) != "").withColumn("__main", key(F.col(name)))
    said = named.select("__main", F.explode(F.array_distinct(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))))).alias("said")).withColumn("key", key(F.col("said"))).where("key <> ''")
    said = said.where(of(F.col("__main")).isNull() | of(F.col("key")).isNull() | (of(F.col("__main")) == of(F.col("key"))))
    votes = said.groupBy("key", "said").agg(F.count(F.lit(1)).alias("n"))
    edges = said.where("key <> __main").select(F.col("__main").alias("src"), F.col("key").alias("dst")).distinct()
    parts = records.connected(edges)
    part = votes.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key"))
    best = part.withColumn("f", of(F.col("key"))).groupBy("part").agg(F.max(F.struct("n", F.length("said").alias("l"), "said"))["said"].alias("best"), F.collect_set("f").alias("fs"))
    canon = best.select("part", F.when(F.size("fs") == 1, F.get("fs", F.lit(0))).otherwise(F.col("best")).alias("canonical"))
    return part.select("part", "key").distinct().join(canon, "part").select("key", "canonical")


def ladder(pending: DataFrame, key: list[str], rungs: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Results of the first rung (a function of pending rows that returns the rows done, with their key) that does each row.

    Each rung sees what the rungs before left undone. Intermediate results are written to the checkpoint folder.
    """
    from .shared import durable

    done = None
    for rung in rungs:
        got = durable(rung(pending))
        done = got if done is None else done.unionByName(got, allowMissingColumns=True)
        pending = durable(pending.join(got.select(*key).distinct(), key, "left_anti"))
        if pending.isEmpty():
            break
    return done


def retryable(status: Column, markers: list[str]) -> Column:
    """Whether an error is worth another try: its text has one of the markers. Successes and null aren't errors."""
    low = F.lower(F.coalesce(status, F.lit("")))
    return ~low.startswith("success") & F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))


def first_named(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """value, column, and `order`: each distinct value of the columns at its first place; earlier columns first within a row."""
    names = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    flat = rows.select(*order, F.explode(names).alias("x")).select(*order, "x.*").where(F.trim(F.coalesce("value", F.lit(""))) != "")
    best = flat.groupBy("value").agg(F.min(F.struct(*order, "at", "column")).alias("b"))
    return best.select("value", "b.column", *[F.col(f"b.{c}").alias(c) for c in order])


def slots(rows: DataFrame, key: str, slot: str, n: int, has: Column, order: list[str]) -> DataFrame:
    """Each key's slots 1..n with the row that fills it: one that `has` names before others, then the first in order; null where none."""
    table = rows.select(key).distinct().withColumn(slot, F.explode(F.sequence(F.lit(1), F.lit(n))))
    best = records.pick(rows.where(F.col(slot).between(1, n)), [key, slot], [F.coalesce(has, F.lit(False)).desc(), *order])
    return table.join(best, [key, slot], "left")


