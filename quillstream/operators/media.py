"""Scene, frame and citation summaries: repair splits, spoken lines, first places, dashboards, trait support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repair_split(sizes: Column, count: int) -> Column:
    """Chunk number (0..) of each entry of an ordered array of word counts, cut into at most `count` chunks.

    A new chunk starts where the current one has words and the next entry would take it over the total
    divided by `count` (1 at least), as long as fewer than `count` chunks exist.
    """
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    target = F.greatest(F.lit(1), F.floor(total / count))
    begin = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("words"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        cut = (s["held"] > 0) & (s["words"] + x > target) & (s["chunk"] + 1 < count)
        chunk = s["chunk"] + cut.cast("int")
        return F.struct(chunk.alias("chunk"), F.when(cut, x.cast("long")).otherwise(s["words"] + x).alias("words"), F.lit(1).alias("held"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, begin, step, lambda s: s["out"])


def representative_sentence(turns: DataFrame, key: list[str], order: list[str], sentences: Column) -> DataFrame:
    """key, sentence, words, chars and `order` of the turn it stands in: of each key's sentences the one with most
    words, then most characters, then the first in order. Keys without a sentence have no row."""
    cut = turns.select(*key, *order, F.posexplode(sentences).alias("__at", "sentence"))
    words = F.size(F.filter(F.split(F.col("sentence"), r"\s+"), lambda w: w != ""))
    cut = cut.withColumn("words", words).withColumn("chars", F.char_length("sentence"))
    best = F.struct((-F.col("words")).alias("w"), (-F.col("chars")).alias("c"), *order, "__at")
    one = cut.groupBy(*key).agg(F.min_by(F.struct("sentence", "words", "chars", *order), best).alias("b"))
    return one.select(*key, "b.*")


def first_place(cited: DataFrame, key: list[str], book: str, first_book: str, chapter: str, passage: str) -> DataFrame:
    """key, passage and chapter of each key's first citation: the first book, then chapter (unknown 999), then id."""
    place = F.struct(F.when(F.col(book).eqNullSafe(F.lit(first_book)), 1).otherwise(2).alias("b"), F.coalesce(F.col(chapter).cast("long"), F.lit(999)).alias("c"), F.col(passage).cast("string").alias("p"))
    one = cited.groupBy(*key).agg(F.min(place).alias("m"))
    return one.select(*key, F.col("m.p").alias("passage"), F.col("m.c").alias("chapter"))


def dashboard_frames(scenes: DataFrame, generations: DataFrame, scene: str, order: str) -> DataFrame:
    """One row for each scene and its first and last frame that has a file.

    scenes: `scene`, first_file, last_file. generations: file, image, score, `order`. A generation is complete when
    it has an image and a finite score; the best is the highest score, earliest on ties. The best image is shown,
    else the frame's own file. Generations are aggregated by file before they meet the frames.
    """
    sides = F.array(F.struct(F.lit("first").alias("side"), F.col("first_file").alias("file")), F.struct(F.lit("last").alias("side"), F.col("last_file").alias("file")))
    frames = scenes.select(scene, F.explode(sides).alias("f")).select(scene, "f.*").where("coalesce(trim(file), '') <> ''")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    done = (F.coalesce(F.trim("image"), F.lit("")) != "") & finite
    rank = F.when(done, F.struct((-F.col("score")).alias("s"), F.col(order)))
    per = generations.groupBy("file").agg(F.count(F.lit(1)).alias("generations"), F.count_if(done).alias("completed"), F.min_by("image", rank).alias("best_image"), F.max(F.when(done, F.col("score"))).alias("best_score"))
    joined = frames.join(per, "file", "left")
    return joined.select(scene, "side", "file", F.coalesce("generations", F.lit(0)).alias("generations"), F.coalesce("completed", F.lit(0)).alias("completed"), "best_score", F.coalesce("best_image", "file").alias("shown"))


def frame_order(frames: DataFrame, scene: str, side: str = "side") -> DataFrame:
    """frames with their place (1..) in the order of scenes, in each of which the first frame comes before the last one and others after."""
    rank = F.when(F.col(side) == "first", 0).when(F.col(side) == "last", 1).otherwise(2)
    return frames.withColumn("place", F.row_number().over(Window.partitionBy(scene).orderBy(rank, F.col(side))))


def dashboard_stats(frames: DataFrame) -> DataFrame:
    """One row over dashboard_frames: frames, frames with a complete image, complete images, frames without any."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("completed") > 0).alias("frames_done"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"), F.count_if(F.col("completed") == 0).alias("frames_open"))
