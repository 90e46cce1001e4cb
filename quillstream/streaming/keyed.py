"""Keyed state of ordered folds: items wait in a list state, in lots, until the watermark has passed them, then are folded in event order.

So micro-batches may bring a key's items in any order; what comes out is the batch fold's result. Needs the RocksDB state store
(prepare).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Items of one row of the list state; buckets that keys are dealt to. Calls to the state store are made for a bucket, not for each of its keys.
LOT, BUCKETS = 1024, 2048


def prepare(spark: SparkSession) -> None:
    """Chooses the state store that keyed state needs, for this session's next streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _ms(seconds: float) -> int:
    """The millisecond that a time of whole microseconds lies in."""
    return round(seconds * 1e6) // 1000


def _packed(rows: list[tuple]) -> list[tuple]:
    """Rows as rows of arrays, LOT in each: state is read and written a row at a time."""
    return [tuple(list(c) for c in zip(*rows[k : k + LOT])) for k in range(0, len(rows), LOT)]


def _arrays(kinds: str) -> str:
    return ", ".join("{} array<{}>".format(*c.split()) for c in f"known boolean, key long, {kinds}".split(", "))


class OrderedFold(StatefulProcessor):
    """A fold over each key's items in the order of (time, id).

    step(open, item) gives (new open value, rows to emit); close(open, watermark in seconds, whether items wait) gives rows if the open
    value has ended for good, else when it will. items and open values are tuples of the two schemas. A state is that of a bucket of
    keys, which come as (known, key): false for the null key.
    """

    def __init__(self, item: str, open_: str, columns: list[str], step: Callable, close: Callable | None):
        self.item, self.open_, self.columns, self.step, self.close_ = item, open_, columns, step, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _arrays(self.item))
        self.state = handle.getListState("open", _arrays(self.open_))
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for frame in rows for x in zip(*(frame[c].tolist() for c in frame.columns[1:]))]
        self.pending.appendList(_packed(new))
        # a bucket has one timer, that of its earliest item: all items that are due are folded when it fires
        first, known = _ms(min(x[2] for x in new)), self.timer.get()
        if known is None or first < known[0]:
            if known is not None:
                self.handle.deleteTimer(known[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, left, out = [], [], []
        for x in _rows(self.pending):
            (due if _ms(x[2]) < mark else left).append(x)
        open_ = {x[:2]: x[2:] for x in _rows(self.state)}
        for x in sorted(due, key=lambda x: x[:4]):
            who = x[:2]
            open_[who], told = self.step(open_.get(who), x[2:])
            out += [(who, r) for r in told]
        next_, wait = [_ms(x[2]) for x in left], {x[:2] for x in left}
        for who in list(open_) if self.close_ else ():
            ended = self.close_(open_[who], mark / 1000, who in wait)
            if isinstance(ended, list):
                out += [(who, r) for r in ended]
                del open_[who]
            else:
                next_.append(max(_ms(ended), mark))
        for state, rows in (self.pending, left), (self.state, [(*who, *x) for who, x in open_.items()]):
            if rows:
                state.put(_packed(rows))
            else:
                state.clear()
        # a timer fires when the watermark is above it
        if next_:
            self.handle.registerTimer(min(next_))
            self.timer.update((min(next_),))
        else:
            self.timer.clear()
        return iter([pd.DataFrame([(k if known else None, *x) for (known, k), x in out], columns=self.columns, dtype=object)] if out else ())

    def close(self) -> None:
        pass


def _rows(state) -> Iterator[tuple]:
    return (x for lot in (state.get() if state.exists() else ()) for x in zip(*lot))


def _run(rows: DataFrame, item: str, open_: str, out: str, step: Callable, close: Callable | None = None) -> DataFrame:
    columns = [c.split()[0] for c in out.split(", ")]
    return rows.groupBy("bucket").transformWithStateInPandas(OrderedFold(item, open_, columns, step, close), out, "Append", "eventTime")


def _keyed(events: DataFrame, key: str, id_col: str, ts: str, late: str, *more) -> DataFrame:
    seen = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    k = F.col(key).cast("long")
    dealt = F.pmod(F.xxhash64(k), F.lit(BUCKETS)).alias("bucket"), k.isNotNull().alias("known"), F.coalesce(k, F.lit(0).cast("long")).alias("key")
    return seen.select(*dealt, (F.unix_micros(ts) / 1e6).alias("s"), F.col(id_col).cast("long").alias("id"), *more)


def budget_partitions(events: DataFrame, size: str, budget: float = 300.0, late: str = "1 day", key: str = "user_id", id_col: str = "event_id", ts: str = "ts") -> DataFrame:
    """key, id, part: greedy partitions of a key's items in event order; an item that would exceed the budget begins a new one.

    An item larger than the budget stands alone; a null size counts as 0. Parts count from 0. An item is told once the watermark has passed it.
    """

    def step(open_, x):
        part, used = open_ or (0, 0.0)
        if used > 0 and used + x[2] > budget:
            part, used = part + 1, 0.0
        return (part, used + x[2]), [(x[1], part)]

    rows = _keyed(events, key, id_col, ts, late, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("size"))
    return _run(rows, "s double, id long, size double", "part long, used double", "key long, id long, part long", step)


def turns(events: DataFrame, gap: float, late: str = "1 hour", key: str = "user_id", id_col: str = "event_id", kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """key, kind, start, end, n of turns in event order: a new one when the kind changes or more than `gap` seconds pass.

    A turn is told when an item begins the next one, or when the watermark has passed its end and the gap. A null kind is a kind of its own.
    """

    def step(open_, x):
        s, _, name = x
        if open_ and open_[0] == name and s - open_[2] <= gap:
            return (name, open_[1], s, open_[3] + 1), []
        return (name, s, s, 1), [_told(open_)] if open_ else []

    def close(open_, mark, waiting):
        return [_told(open_)] if mark > open_[2] + gap and not waiting else max(open_[2] + gap, mark)

    rows = _keyed(events, key, id_col, ts, late, F.coalesce(F.col(kind), F.lit("\u0000")).alias("kind"))
    return _run(rows, "s double, id long, kind string", "kind string, start double, end double, n long", "key long, kind string, start double, end double, n long", step, close)


def _told(open_: tuple) -> tuple:
    return (None if open_[0] == "\u0000" else open_[0], *open_[1:])
