"""Order-dependent folds, as higher-order functions over one group's ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_bins(sizes: Column, budget: float) -> Column:
    """Bin number (0..) of each entry of an ordered array: a new bin where adding would exceed the budget."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        over = (s["used"] > 0) & (s["used"] + d > budget)
        bin_ = s["bin"] + over.cast("int")
        return F.struct(bin_.alias("bin"), F.when(over, d).otherwise(s["used"] + d).alias("used"), F.concat(s["out"], F.array(bin_)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda d: d.cast("double")), start, step, lambda s: s["out"])


def word_budget(counts: Column, target: int = 450, most: int = 650, overlap: int = 1) -> Column:
    """Chunks (first, last index from 0) over an ordered array of word counts.

    A chunk takes units until it has `target` words or the next would exceed `most`; the next chunk starts
    `overlap` units (0 or 1) before its end. One unit over the limit stands alone.
    """
    if overlap not in (0, 1):
        raise ValueError("overlap must be 0 or 1")
    n = F.size(counts)
    # a chunk that ends at i is closed when unit i + 1 arrives; the overlap then reopens it with the last units
    begin = F.struct(F.lit(0).alias("start"), F.lit(0).cast("long").alias("words"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def tail(start: Column, end: Column) -> Column:
        return F.greatest(start + 1, end - overlap)

    def step(s: Column, i: Column) -> Column:
        c = F.get(counts, i).cast("long")
        fits = (i == s["start"]) | ((s["words"] < target) & (s["words"] + c <= most))
        again = tail(s["start"], i)
        held = F.aggregate(F.slice(counts, again + 1, F.greatest(i - again, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
        # reopened units and the new one must fit together as well, else the chunk in between is emitted on its own
        alone = (again < i) & ~((held < target) & (held + c <= most))
        closed = F.concat(s["out"], F.array(F.struct(s["start"].cast("int").alias("first"), (i - 1).cast("int").alias("last"))))
        closed2 = F.concat(closed, F.array(F.struct(again.cast("int").alias("first"), (i - 1).cast("int").alias("last"))))
        return F.when(fits, F.struct(s["start"].alias("start"), (s["words"] + c).alias("words"), s["out"].alias("out"))).otherwise(
            F.struct(F.when(alone, i).otherwise(again).cast("int").alias("start"), F.when(alone, c).otherwise(held + c).alias("words"), F.when(alone, closed2).otherwise(closed).alias("out"))
        )

    end = lambda s: F.when(n > 0, F.concat(s["out"], F.array(F.struct(s["start"].cast("int").alias("first"), (n - 1).cast("int").alias("last"))))).otherwise(s["out"])
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), begin, step, end)


def reconcile(items: Column, start_tolerance: float = 0.75, end_tolerance: float = 1.5) -> Column:
    """Greedy near-duplicate merge of an array of struct(start, end, sentence), sorted by (start, end).

    The first accepted item within both tolerances is a duplicate: the longer sentence's row stays in its place.
    """
    near = lambda a, x: (F.abs(a["start"] - x["start"]) <= start_tolerance) & (F.abs(a["end"] - x["end"]) <= end_tolerance)

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda a: near(a, x)), F.lit(True))
        kept = F.transform(acc, lambda a, i: F.when((i + 1 == at) & (F.length(x["sentence"]) > F.length(a["sentence"])), x).otherwise(a))
        return F.when(at > 0, kept).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


def scene_starts(frames: Column, threshold: float, min_frames: int) -> Column:
    """Frame numbers at which a scene starts, of an ordered array of struct(frame, diff); 0 is the first."""
    def step(acc: Column, f: Column) -> Column:
        cut = (f["diff"] > threshold) & (f["frame"] - F.element_at(acc, -1) >= min_frames)
        return F.when(cut, F.concat(acc, F.array(f["frame"]))).otherwise(acc)

    return F.aggregate(frames, F.array(F.lit(0).cast("long")), step)


def scenes(frames: Column, threshold: float, min_frames: int, fps: float) -> Column:
    """An array of struct(scene, first, last, start, end, duration) of an ordered array of struct(frame, diff): frames from 0, scenes from 1.

    A scene ends before the next start (scene_starts); what is left is the last scene, unless that is the last frame alone. Seconds are
    rounded to three places. No frames: no scenes.
    """
    total = F.coalesce(F.array_max(F.transform(frames, lambda f: f["frame"])) + 1, F.lit(0).cast("long"))
    starts = scene_starts(frames, threshold, min_frames)
    seconds = lambda n: F.round(n / F.lit(float(fps)), 3)

    def one(first: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), total)
        return F.struct((i + 1).cast("long").alias("scene"), first.alias("first"), (end - 1).alias("last"), seconds(first).alias("start"), seconds(end).alias("end"), F.round(end / F.lit(float(fps)) - first / F.lit(float(fps)), 3).alias("duration"))

    return F.transform(F.filter(starts, lambda s, i: (i + 1 < F.size(starts)) | (s < total - 1)), one)


def ordered(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """key, values: one group's values in order; a group has to fit a task, as with any fold over it."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return rows.groupBy(*key).agg(F.transform(packed, lambda s: s["__v"]).alias("values"))
