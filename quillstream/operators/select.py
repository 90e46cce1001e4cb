"""Projections, filters and classifications, as column expressions or functions of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(rows: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    """Renamed and derived columns, in the order given."""
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def merge_structs(left: Column, right: Column, left_fields: list[str], right_fields: list[str]) -> Column:
    """One struct with the fields of both; where both have a field the right one's value wins, null or not."""
    own = [left[f].alias(f) for f in left_fields if f not in right_fields]
    return F.struct(*own, *[right[f].alias(f) for f in right_fields])


def keep_fields(array: Column, fields: list[str]) -> Column:
    """An array's structs cut down to the allowed fields; a null array is empty."""
    return F.coalesce(F.transform(array, lambda x: F.struct(*[x[f].alias(f) for f in fields])), F.array())


def succeeded(status: Column) -> Column:
    """Whether a status begins with success; null counts as no."""
    return F.coalesce(status, F.lit("")).startswith("success")


def in_range(rows: DataFrame, column: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows whose column lies between the bounds, both included; a bound that is None doesn't limit."""
    if start is not None:
        rows = rows.where(F.col(column) >= start)
    return rows if end is None else rows.where(F.col(column) <= end)


def by_ids(rows: DataFrame, column: str, ids: list) -> DataFrame:
    """Rows of the listed ids; an empty list selects all."""
    return rows.where(F.col(column).isin(*ids)) if ids else rows


def by_paths(rows: DataFrame, column: str, paths: list[str]) -> DataFrame:
    """Rows whose path, or the name after its last slash, is listed; backslashes count as slashes on both sides."""
    wanted = sorted({p.replace("\\", "/") for p in paths})
    own = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    return rows.where(own.isin(*wanted) | F.element_at(F.split(own, "/"), -1).isin(*[w.rsplit("/", 1)[-1] for w in wanted if "/" not in w] or [""]))


def search(rows: DataFrame, needle: str, fields: list[str], equal: dict | None = None, flag: Column | None = None) -> DataFrame:
    """Rows with the needle in one of the fields (case ignored, blank: all), the given values, and the flag set."""
    low = needle.strip().lower()
    if low:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))), F.lit(low))
        rows = rows.where(hit)
    for c, v in (equal or {}).items():
        rows = rows.where(F.col(c) == v)
    return rows if flag is None else rows.where(flag)


def mentions(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains one of the words; null contains none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def classify(name: Column, exact: dict[str, str], patterns: list[tuple[str, str]], otherwise: str, exceptions: tuple[str, ...] = ()) -> Column:
    """The class of a name: exceptions first (otherwise), then exact names, then the first pattern that is found."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.when(low.isin(*exceptions), F.lit(otherwise)) if exceptions else F.when(F.lit(False), F.lit(otherwise))
    for k, v in exact.items():
        out = out.when(low == k, F.lit(v))
    for p, v in patterns:
        out = out.when(low.rlike(p), F.lit(v))
    return out.otherwise(F.lit(otherwise))


def filled(c: Column) -> Column:
    """Whether a value is there: neither null nor blank."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) != ""


def is_number(c: Column) -> Column:
    return c.cast("string").try_cast("double").isNotNull()


def needs_more(traits: list[Column], portrait_words: Column, least_traits: int = 3, least_words: int = 15) -> Column:
    """Whether fewer than `least_traits` of the (already judged) traits hold or the portrait is short."""
    n = F.lit(0)
    for x in traits:
        n = n + F.when(x, 1).otherwise(0)
    return (n < least_traits) | (F.coalesce(portrait_words, F.lit(0)) < least_words)


def at_point(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, order: list[str], width: float) -> DataFrame:
    """Each point with the first span, in `order`, that holds it; both ends belong to a span. Points outside have none.

    Where order begins with the start, only spans that end later than all before them can be a first one: their ends rise in that
    order, so the first that holds a point is the one of least end not before it, if it has begun by then. Both are found by passes in
    stretches of `width`, and no pair is made besides these. Other orders meet in buckets of `width`, an equi-join of all pairs.
    """
    from .intervals import running

    names = [c for c in spans.columns]
    points = points.distinct()
    if order[0] == start:
        # NaN is the greatest end, as it is in comparisons
        last = F.nanvl(F.col(end).cast("double"), F.lit(float("inf")))
        known = spans.where(F.col(start) <= F.col(end)).select(F.col(start).cast("double").alias("__at"), last.alias("__end"), F.struct(*order).alias("__o"), F.struct(*names).alias("__s"))
        tops = running(known, [], "__at", width, ["__at", "__o"], "__end", "__top").where("__end = __top")
        none = lambda kind: F.lit(None).cast(kind)
        ends = tops.select("__end", F.lit(1).alias("__k"), F.struct("__end", "__o", "__s").alias("__v"), none(points.select(F.struct(*points.columns).alias("p")).schema["p"].dataType).alias("__p"))
        asked = points.where(F.col(point).isNotNull()).select(F.nanvl(F.col(point).cast("double"), F.lit(float("inf"))).alias("__end"), F.lit(0).alias("__k"), none(ends.schema["__v"].dataType).alias("__v"), F.struct(*points.columns).alias("__p"))
        met = running(ends.unionByName(asked), [], "__end", width, [F.desc("__end"), F.desc("__k")], "__v", "__f", "min", True).where("__k = 0")
        held = met.select("__p.*", F.col("__f.__s").alias("__s")).where(F.col(f"__s.{start}") <= F.col(point))
        return held.select(*points.columns, "__s.*")
    wide = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    met = points.withColumn("__b", F.floor(F.col(point) / width)).join(wide, "__b").where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end)))
    best = met.groupBy(*points.columns).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("__s"))
    return best.select(*points.columns, "__s.*")


def duration_class(seconds: Column) -> Column:
    """long above 30, brief below 2, usual from 5 to 10 with both ends, else null."""
    return F.when(seconds > 30, "long").when(seconds < 2, "brief").when(seconds.between(5, 10), "usual")


def check_request(rows: DataFrame, least_one: list[str], ranges: dict[str, tuple[float, float]], out: str = "errors") -> DataFrame:
    """rows with an array of what is wrong with each as a request: none of the needed fields given (blank texts aren't), numbers outside
    their ranges (ends included, nulls allowed)."""
    given = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "" for c in least_one]
    none = ~reduce(lambda a, b: a | b, given, F.lit(not given))
    wrong = [F.when(none, F.lit("one of " + ", ".join(least_one) + " is needed"))]
    wrong += [F.when(~F.col(c).between(low, high), F.lit(f"{c} must lie between {low} and {high}")) for c, (low, high) in ranges.items()]
    return rows.withColumn(out, F.array_compact(F.array(*wrong)))
