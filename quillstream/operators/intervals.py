"""Interval joins and sessionization over seconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(items: DataFrame, spans: DataFrame, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with item.end >= span.start and item.start < span.end, besides equal keys.

    items: start, end and keys; spans: s, e and the same keys; other columns must differ in name. Both sides are
    dealt into buckets of `width` seconds, so the join is an equi-join on (keys, bucket) and never a nested
    loop. A pair that shares several buckets is emitted in the first of them only.
    """
    lo, hi = lambda c: F.floor(F.col(c) / width), lambda c: F.floor(F.col(c) / width)
    left = items.withColumn("__b", F.explode(F.sequence(lo("start"), F.greatest(lo("start"), hi("end")))))
    right = spans.withColumn("__b", F.explode(F.sequence(lo("s"), F.greatest(lo("s"), hi("e")))))
    first = F.greatest(lo("start"), lo("s"))
    return left.join(right, [*keys, "__b"]).where((F.col("end") >= F.col("s")) & (F.col("start") < F.col("e")) & (F.col("__b") == first)).drop("__b")


def running(rows: DataFrame, keys: list[str], at: str, width: float, order: list, value: str, name: str, how: str = "max", backwards: bool = False) -> DataFrame:
    """rows with `name`: the greatest (how "max") or least ("min") value or the sum ("sum") of a key so far in order, the row's own included; nulls don't count.

    order begins with `at`, rising, or falling if backwards. A key is cut into stretches of `width` of `at`: windows run within a stretch, and
    what earlier stretches leave is carried over, so a key with any share of the rows is dealt to as many tasks as it has stretches.
    """
    best = {"max": F.max, "min": F.min, "sum": F.sum}[how]
    pick = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(F.col(a) + F.col(b), a, b)}[how]
    cut = rows.withColumn("__cut", F.floor(F.col(at) / width))
    inner = Window.partitionBy(*keys, "__cut").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.desc("__cut") if backwards else F.asc("__cut")
    outer = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    whole = cut.groupBy(*keys, "__cut").agg(best(value).alias("__own")).withColumn("__carried", best("__own").over(outer))
    side = whole.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__cut").alias("__c"), "__carried")
    same = F.col("__cut") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = cut.withColumn("__in", best(value).over(inner)).join(side, same)
    return met.select(*rows.columns, pick("__in", "__carried").alias(name))


def overlap_or_nearest(items: DataFrame, clips: DataFrame, keys: list[str], item_id: str, clip: list[str], width: float) -> DataFrame:
    """clips (keys, `clip`, s, e) with the items (keys, item_id, start, end) that overlap them, else the nearest item, the
    least id on ties; `overlaps` tells which. A clip of a key without items has no row.

    Overlaps come from the bucketed join. For the clips without any, the nearest item is the one before of latest end or
    the one after of earliest start, found by one ordered pass in each direction, in stretches of `width` with a carried item.
    """
    met = overlap_join(items, clips, width, tuple(keys)).withColumn("overlaps", F.lit(True))
    alone = clips.join(met.select(*keys, *clip).distinct(), [*keys, *clip], "left_anti")
    none = F.lit(None)
    # at one time, clips come before items that end there, and after items that start there
    before = items.select(*keys, *[none.alias(c) for c in (*clip, "s", "e")], F.col("end").alias("__at"), F.lit(1).alias("__k"), F.struct("end", (-F.col(item_id)).alias("n"), "start").alias("__i"))
    before = before.unionByName(alone.select(*keys, *clip, "s", "e", F.col("s").alias("__at"), F.lit(0).alias("__k"), none.alias("__i")))
    last = running(before, keys, "__at", width, ["__at", "__k"], "__i", "__r").where("__k = 0 and __r is not null")
    last = last.select(*keys, *clip, "s", "e", F.struct((F.col("s") - F.col("__r.end")).alias("d"), (-F.col("__r.n")).alias(item_id), F.col("__r.start").alias("start"), F.col("__r.end").alias("end")).alias("__b"))
    after = items.select(*keys, *[none.alias(c) for c in (*clip, "s", "e")], F.col("start").alias("__at"), F.lit(1).alias("__k"), F.struct("start", F.col(item_id).alias("n"), "end").alias("__i"))
    after = after.unionByName(alone.select(*keys, *clip, "s", "e", F.col("e").alias("__at"), F.lit(0).alias("__k"), none.alias("__i")))
    next_ = running(after, keys, "__at", width, [F.desc("__at"), F.desc("__k")], "__i", "__r", "min", True).where("__k = 0 and __r is not null")
    next_ = next_.select(*keys, *clip, "s", "e", F.struct((F.col("__r.start") - F.col("e")).alias("d"), F.col("__r.n").alias(item_id), F.col("__r.start").alias("start"), F.col("__r.end").alias("end")).alias("__b"))
    best = last.unionByName(next_).groupBy(*keys, *clip, "s", "e").agg(F.min("__b").alias("__b"))
    near = best.select(*keys, *clip, "s", "e", F.col(f"__b.{item_id}").alias(item_id), F.col("__b.start").alias("start"), F.col("__b.end").alias("end"), F.lit(False).alias("overlaps"))
    return met.select(*near.columns).unionByName(near)


#: Rows of a key whose jumps one task follows at once.
HOPS = 1 << 17


def _visited(jumps: DataFrame, first: DataFrame, keys: list[str], hops: int | None = None) -> DataFrame:
    """keys, __from of the rows that are met from a key's `first` rows on (keys, __from) by its jumps (keys, __from, __to; __to > __from).

    Tasks follow the jumps within stretches of `hops` rows. Only rows that a jump from another stretch meets may be where a stretch is entered; which of
    them are, is found by doubling what leads from one of them to the next. Then each stretch is followed once more from there.
    """
    import numpy as np
    import pyarrow as pa

    from .shared import durable

    hops = hops or HOPS
    stretch = lambda c: F.floor((F.col(c) - 1) / hops)
    same = lambda a, b, x, y: reduce(lambda p, q: p & q, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys], F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    kinds = [jumps.schema[c] for c in keys]

    def grouped(entered: DataFrame, follow, names: list[str]) -> DataFrame:
        # keys go through as they are; a group is one key's rows of one stretch
        rows = jumps.alias("j").join(entered.withColumn("__in", F.lit(True)).alias("e"), same("j", "e", "__from", "__from"), "left").select("j.*", F.col("e.__in").isNotNull().alias("__in"))

        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("__from")
            cells = follow(t["__from"].to_numpy(), t["__to"].to_numpy(), t["__in"].to_numpy())
            own = [pa.array([t[c][0].as_py()] * len(cells[0]), t[c].type) for c in keys]
            return pa.table([*own, *[pa.array(x, pa.int64()) for x in cells]], names=[*keys, *names])

        ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], *[f"{n} long" for n in names]])
        return rows.groupBy(*keys, stretch("__from").alias("__stretch")).applyInArrow(run, ddl)

    def onward(at, to):
        """Places of the rows that are jumped to, -1 where the stretch has none."""
        place = np.minimum(np.searchsorted(at, to), len(at) - 1)
        return np.where(at[place] == to, place, -1).tolist()

    def leave(at, to, inside):
        out = to.tolist()
        for i, k in zip(range(len(at) - 1, -1, -1), reversed(onward(at, to))):
            if k >= 0:
                out[i] = out[k]
        return at[inside], np.array(out, np.int64)[inside]

    def walk(at, to, inside):
        met, ahead = inside.copy(), onward(at, to)
        for i in np.flatnonzero(inside).tolist():
            while (i := ahead[i]) >= 0 and not met[i]:
                met[i] = True
        return (np.unique(np.concatenate([at[met], to[met]])),)

    doors = durable(jumps.where(stretch("__from") != stretch("__to")).select(*keys, F.col("__to").alias("__from")).unionByName(first).distinct())
    leads = durable(grouped(doors, leave, ["__from", "__to"]))
    met, before = first, 0
    while (n := met.count()) != before:
        before = n
        new = met.alias("m").join(leads.alias("j"), same("m", "j", "__from", "__from")).select(*[F.col(f"m.{c}") for c in keys], F.col("j.__to").alias("__from"))
        met = durable(met.unionByName(new).distinct())
        leads = durable(leads.alias("a").join(leads.alias("b"), same("a", "b", "__to", "__from")).select(*[F.col(f"a.{c}") for c in keys], F.col("a.__from").alias("__from"), F.col("b.__to").alias("__to")))
    return durable(grouped(met, walk, ["__from"]).unionByName(met).distinct())


def budget_parts(rows: DataFrame, keys: list[str], at: str, width: float, order: list[str], size: str, budget: int, name: str = "part") -> DataFrame:
    """rows with the number (0..) of their part in their key's greedy partition: a row that would exceed the budget begins a new part.

    For keys of any length; folds.greedy_bins does the same to a short key's array. Sizes are whole numbers, not negative, null is 0; a
    row over the budget stands alone. order begins with `at` and tells rows of a key apart. Every row's next start is found by its
    place among the prefix sums; which starts are really met, from a key's first row on, by following those jumps in stretches of HOPS rows, and
    by doubling what leads from stretch to stretch: as many joins of these few rows as the logarithm of the number of stretches. No key is ever gathered.
    """
    from .shared import durable

    step = rows.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))).withColumn("__one", F.lit(1).cast("long"))
    step = running(step, keys, at, width, order, "__one", "__pos", "sum")
    step = durable(running(step, keys, at, width, order, "__size", "__sum", "sum"))
    base = F.col("__sum") - F.col("__size")
    k = [F.col(c) for c in keys]
    # the first row that takes something, and the first whose sum is above the budget, by one pass over all sums from above
    ask = lambda kind, value: step.select(*k, value.alias("__v"), F.lit(0).alias("__k"), F.lit(kind).alias("__kind"), "__pos", F.lit(None).cast("long").alias("__hit"))
    sums = step.select(*k, F.col("__sum").alias("__v"), F.lit(1).alias("__k"), F.lit(None).cast("int").alias("__kind"), "__pos", F.col("__pos").alias("__hit"))
    both = sums.unionByName(ask(0, base)).unionByName(ask(1, base + budget))
    found = running(both, keys, "__v", 1000.0 * max(budget, 1), [F.desc("__v"), "__k"], "__hit", "__found", "min", True).where("__k = 0")
    per = found.groupBy(*keys, "__pos").agg(F.max(F.when(F.col("__kind") == 0, F.col("__found"))).alias("__takes"), F.max(F.when(F.col("__kind") == 1, F.col("__found"))).alias("__over"))
    jumps = durable(per.select(*k, F.col("__pos").alias("__from"), F.greatest("__over", F.col("__takes") + 1).alias("__to")).where("__over is not null"))
    last = step.groupBy(*keys).agg(F.max("__pos").alias("__last"))
    same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in keys], F.lit(True))
    jumps = jumps.alias("j").join(last.alias("l"), same("j", "l")).where("__to <= __last").select("j.*")
    met = _visited(durable(jumps), durable(step.where("__pos = 1").select(*k, F.col("__pos").alias("__from"))), keys)
    starts = met.withColumn("__start", F.lit(1).cast("long"))
    on = same("r", "s") & (F.col("r.__pos") == F.col("s.__from"))
    flagged = step.alias("r").join(starts.alias("s"), on, "left").select("r.*", "s.__start")
    return running(flagged, keys, at, width, order, "__start", "__part", "sum").select(*rows.columns, (F.col("__part") - 1).alias(name))


def reconciled(rows: DataFrame, keys: list[str], start_tolerance: float = 0.75, end_tolerance: float = 1.5, width: float = 3600.0) -> DataFrame:
    """keys, start, end, sentence of the items that stay when near-duplicates merge greedily in the order of (start, end, sentence).

    The first accepted item within both tolerances is a duplicate: the longer sentence's row stays in its place. An item is near none
    before it whose starts are all further than the tolerance, so a key's timeline is cut there and its parts are folded apart, each a group of its own.
    Starts and ends aren't null.
    """
    from .folds import reconcile

    rows = rows.select(*keys, "start", "end", "sentence")
    # equal starts stand in one stretch; the start before is the greatest lesser one
    starts = rows.select(*keys, "start").distinct()
    cut = starts.withColumn("__cut", F.floor(F.col("start") / width))
    whole = cut.groupBy(*keys, "__cut").agg(F.max("start").alias("__last"))
    side = whole.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__cut").alias("__c"), F.max("__last").over(Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    same = F.col("__cut") == F.col("__c")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    ahead = cut.withColumn("__prev", F.lag("start").over(Window.partitionBy(*keys, "__cut").orderBy("start"))).join(side, same)
    prev = F.coalesce("__prev", "__carried")
    flagged = ahead.select(*keys, "start", F.when(prev.isNull() | (F.col("start") - prev > start_tolerance), F.col("start")).alias("__new"))
    parts = running(flagged, keys, "start", width, ["start"], "__new", "__part").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("start").alias("__s"), "__part")
    same = F.col("start") == F.col("__s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    grouped = rows.join(parts, same).groupBy(*keys, "__part").agg(F.array_sort(F.collect_list(F.struct("start", "end", "sentence"))).alias("__x"))
    return grouped.select(*keys, F.explode(reconcile(F.col("__x"), start_tolerance, end_tolerance)).alias("__x")).select(*keys, "__x.*")


def turns(rows: DataFrame, part: list[str], key: str, start: str, end: str, gap: float, order: list[str]) -> DataFrame:
    """rows with `turn` (1..): a new one when the key changes or the gap to the item before is over `gap` seconds."""
    w = Window.partitionBy(*part).orderBy(*order)
    new = F.lag(key).over(w).isNull() | (F.lag(key).over(w) != F.col(key)) | (F.col(start) - F.lag(end).over(w) > gap)
    return rows.withColumn("__new", new.cast("long")).withColumn("turn", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def gaps(rows: DataFrame, part: list[str], start: str, end: str, order: list[str], least: float = 0.1) -> DataFrame:
    """rows whose successor starts more than `least` seconds after their end, with `gap`."""
    ahead = F.lead(start).over(Window.partitionBy(*part).orderBy(*order))
    return rows.withColumn("gap", ahead - F.col(end)).where(F.col("gap") > least)


def subdivide(rows: DataFrame, start: str, end: str, most: float) -> DataFrame:
    """Intervals as pieces of `most` seconds, the last one shorter; empty intervals vanish."""
    n = F.ceil((F.col(end) - F.col(start)) / most).cast("int")
    pieces = rows.where(F.col(end) > F.col(start)).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    return pieces.withColumn("piece_start", F.col(start) + F.col("piece") * most).withColumn("piece_end", F.least(F.col(end), F.col(start) + (F.col("piece") + 1) * most))


def chunk_starts(duration: Column, chunk: float, overlap: float) -> Column:
    """Starts of windows of `chunk` seconds that overlap by `overlap`, up to the one that reaches the end."""
    step = chunk - overlap
    n = F.greatest(F.lit(0), F.ceil((duration - chunk) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n), lambda k: k * F.lit(float(step)))
