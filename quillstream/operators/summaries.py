"""Aggregates of cited records: first values, sorted sets, nested groups, violations, objectives, neighbours in order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mention_counts(links: DataFrame, entity: str, place: str) -> DataFrame:
    """entity, place, mention_count."""
    return links.groupBy(entity, place).agg(F.count(F.lit(1)).alias("mention_count"))


def export(rows: DataFrame, key: list[str], order: list[str], first: list[str], sets: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """One row a key: of `first` columns the value of the first row in order that has one, `sets` as sorted distinct
    values, `lists` as all values in order (nulls left out)."""
    place = F.struct(*order)
    aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in first]
    aggs += [F.sort_array(F.collect_set(c)).alias(n) for n, c in sets.items()]
    aggs += [F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(place.alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]).alias(n) for n, c in lists.items()]
    return rows.groupBy(*key).agg(*aggs)


def distinct_places(rows: DataFrame, key: list[str], place: str, fields: list[str]) -> DataFrame:
    """key, places: distinct structs of (place as text, fields), by the text; of rows that share a place the least fields."""
    one = rows.where(F.col(place).isNotNull()).groupBy(*key, F.col(place).cast("string").alias("place")).agg(F.min(F.struct(*fields)).alias("f"))
    return one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "f.*"))).alias("places"))


def nested(rows: DataFrame, outer: str, inner: str, order: list[str], fields: list[str]) -> DataFrame:
    """outer, groups: an array of (inner, items), both sorted, items by `order`."""
    per = rows.groupBy(outer, inner).agg(F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("items"))
    return per.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, "items"))).alias("groups"))


def count_filled(array: Column, field: str) -> Column:
    """How many structs of an array have the field (neither null nor blank); 0 for null arrays."""
    return F.coalesce(F.size(F.filter(array, lambda x: F.trim(F.coalesce(x[field].cast("string"), F.lit(""))) != "")), F.lit(0)).cast("long")


def frequencies(hits: DataFrame, ids: str) -> DataFrame:
    """id, frequency: how many hits list an id (an array column; repeats within a hit count)."""
    return hits.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("frequency"))


def joined_text(rows: DataFrame, key: list[str], order: list[str], text: str, between: str = " ") -> DataFrame:
    """key, text: the rows' texts in order, blank ones left out."""
    kept = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) != "", F.struct(*order, F.col(text).alias("__t")))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: F.trim(x["__t"])), between).alias(text))


def objective(weights: dict[str, float]) -> Column:
    """Weighted sum of columns; nulls count as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()])


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """rule, item of every row of the rules' frames (one column each): what is wrong, and nothing if all is well."""
    frames = [df.select(F.lit(n).alias("rule"), F.col(df.columns[0]).cast("string").alias("item")) for n, df in rules.items()]
    return reduce(DataFrame.unionByName, frames)


def verdict(found: DataFrame) -> DataFrame:
    """n_errors, valid of a frame of violations; one row."""
    return found.agg(F.count(F.lit(1)).alias("n_errors"), (F.count(F.lit(1)) == 0).alias("valid"))


def bitrate(size: Column, seconds: Column) -> Column:
    """Bits a second of summed bytes, rounded half to even, 1 at least; null where there is no duration."""
    return F.greatest(F.lit(1), F.when(seconds > 0, F.bround(size * 8 / seconds)).cast("long"))


def last_turns(rows: DataFrame, key: list[str], order: list[str], keep: int, always: Column) -> DataFrame:
    """The last `keep` rows of a key in order, besides those that `always` names, which don't count."""
    w = Window.partitionBy(*key, always).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).withColumn("__a", always).where(F.col("__a") | (F.col("__n") <= keep)).drop("__n", "__a")


def around(text: Column, needle: str, reach: int) -> Column:
    """The first place of the needle with `reach` characters on either side; null where it isn't."""
    at = F.instr(text, needle)
    return F.when(at > 0, F.substr(text, F.greatest(at - reach, F.lit(1)), at + len(needle) + reach - F.greatest(at - reach, F.lit(1))))


def words_around(words: Column, word: str, reach: int) -> Column:
    """The first place of a word in an array with `reach` words on either side, joined; null where it isn't."""
    at = F.array_position(words, word)
    start = F.greatest(at - reach, F.lit(1).cast("long")).cast("int")
    return F.when(at > 0, F.array_join(F.slice(words, start, (at + reach - start + 1).cast("int")), " "))


def top_per(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key in order, with their rank (1..)."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)


def after(rows: DataFrame, order: list[str], id_col: str, cursor, limit: int | None = None) -> DataFrame:
    """Rows that come after the cursor's row in order (nothing where it isn't found; all for None), `limit` at most."""
    if cursor is not None:
        at = rows.where(F.col(id_col) == cursor).agg(F.min(F.struct(*order)).alias("__at"))
        rows = rows.join(F.broadcast(at), F.struct(*order) > F.col("__at")).drop("__at")  # one row, whatever the table
    return rows if limit is None else rows.orderBy(*order).limit(limit)


def sentinel_order(columns: dict[str, int | str]) -> list[Column]:
    """Ascending order in which nulls count as the given values."""
    return [F.coalesce(F.col(c), F.lit(v)).asc() for c, v in columns.items()]


def subset(small: Column, large: Column) -> Column:
    """Whether all entries of an array are in the other; null arrays are empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(small, none), F.coalesce(large, none))) == 0


def union_arrays(arrays: list[Column]) -> Column:
    """Sorted distinct entries of all arrays; null arrays are empty, null entries left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))))


def apply_all(rows: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    return reduce(lambda df, f: f(df), steps, rows)
