"""Structured Streaming variants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Microseconds from the year 1 to 1970.
_YEAR_1 = 62_135_596_800_000_000


def stream_parquet(spark: SparkSession, path: str, files_a_batch: int | None = 16) -> DataFrame:
    """A stream of the files of a Parquet folder, or of a single file.

    Files that aren't in the order of their events need None: all that are there make one batch. With several, the watermark of
    the first files drops what later ones bring.
    """
    from ..sources.jsonl import _fs

    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    fs, at = _fs(spark, path)
    if fs.exists(at) and fs.getFileStatus(at).isFile():  # streams are read from folders
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _moved(spark: SparkSession, step: str, early: bool) -> int:
    """Microseconds, a whole number of steps, by which times from the year 1 on lie after 1970; 0 if not `early`."""
    if not early:
        return 0
    one = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {step})").first()[0]
    return -(-_YEAR_1 // one) * one


def _later(c: str, micros: int):
    return F.timestamp_micros(F.unix_micros(F.col(c).cast("timestamp")) + F.lit(micros).cast("long"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = "user_id", ts: str = "ts", early: bool = False) -> DataFrame:
    """Sessions by gap; a session ends when the watermark passes it. Unlike turns, only the gap counts. early: as for `sliding`."""
    by = _moved(events.sparkSession, gap, early)
    events = events.withColumn(ts, _later(ts, by))
    counted = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, _later("session_window.start", -by).alias("start"), _later("session_window.end", -by).alias("end"), "n")


def _turns(gap: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # (kind, start, end, n) of the open turn
        if state.hasTimedOut:
            kind, start, end, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], kind, start, end, n)], columns=["user", "kind", "start", "end", "n"])
            return
        open_, out = state.getOption, []
        for r in pd.concat(list(frames)).sort_values(["s", "event_id"], kind="stable").itertuples():
            if open_ and open_[0] == r.kind and r.s - open_[2] <= gap:
                open_ = (open_[0], open_[1], max(open_[2], r.s), open_[3] + 1)
            else:
                if open_:
                    out.append((key[0], *open_))
                open_ = (r.kind, r.s, r.s, 1)
        state.update(open_)
        state.setTimeoutTimestamp(max(int((open_[2] + gap) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user", "kind", "start", "end", "n"])

    return run


def turns(events: DataFrame, gap: float, late: str = "1 hour") -> DataFrame:
    """user, kind, start, end, n of turns: a new one when the kind changes or more than `gap` seconds pass.

    events: user_id, event_id, event_type, ts. A keyed state holds a user's open turn, which is told when another begins or
    the watermark has passed its end and the gap. Within a batch events are put in order; later ones than the watermark are dropped.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("user_id").alias("user"), "event_id", F.col("event_type").alias("kind"), "ts", (F.unix_micros("ts") / 1e6).alias("s"))
    kinds = "user long, kind string, start double, end double, n long"
    return rows.groupBy("user").applyInPandasWithState(_turns(gap), kinds, "kind string, start double, end double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def sliding(events: DataFrame, width: str = "900 seconds", step: str = "780 seconds", late: str = "1 day", ts: str = "ts", early: bool = False) -> DataFrame:
    """start, end, n of overlapping windows; one is told when the watermark passes its end.

    A watermark begins at 1970 and drops what ended before. early: such events count too, as times are moved while they are
    counted; the stream can't be joined then with others whose watermarks aren't moved.
    """
    by = _moved(events.sparkSession, step, early)
    events = events.withColumn(ts, _later(ts, by))
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(_later("window.start", -by).alias("start"), _later("window.end", -by).alias("end"), "n")


def refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `apply` on what has arrived since the last call, then stops."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Appends what has arrived to a JSON Lines log, each row once, then stops."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
