"""Keyed state: streamed folds over shuffled micro-batches equal the folds of the whole."""

import datetime
import random

import pytest

from quillstream.streaming import keyed
from quillstream.streaming import turns as streams

START = datetime.datetime(2024, 1, 1)


def arrivals(spark, path, rows, batches, seed):
    """rows in `batches` files of shuffled order, and one last event that moves the watermark past everything."""
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    rows = [rows[k::batches] for k in range(batches)] + [[(99, 0, "end", 0.0, START + datetime.timedelta(days=400))], [(99, 1, "end", 0.0, START + datetime.timedelta(days=401))]]
    for lot in rows:
        spark.createDataFrame(lot, "user_id long, event_id long, event_type string, value double, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return streams.stream_parquet(spark, path, 1)


@pytest.fixture
def items():
    rng = random.Random(4)
    out, at = [], {1: 0.0, 2: 0.0, 3: 5.0}
    for k in range(90):
        u = rng.choice([1, 1, 1, 2, 3])
        at[u] += rng.choice([0, 0.5, 1, 2, 2.001, 3])
        out.append((u, k, rng.choice(["a", "b", None]), rng.choice([0.0, 10.0, 99.5, 150.0, 400.0]), START + datetime.timedelta(seconds=at[u])))
    return out


def seconds(ts):
    return (ts - datetime.datetime(1970, 1, 1)).total_seconds()


def test_budget_partitions(spark, tmp_path, items):
    keyed.prepare(spark)
    stream = keyed.budget_partitions(arrivals(spark, f"{tmp_path}/in", items, 4, 1), "value", 300.0, "30 days")
    streams.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got = sorted((r.key, r.id, r.part) for r in spark.read.json(f"{tmp_path}/out").where("key < 99").collect())
    want = []
    for u in (1, 2, 3):
        part, used = 0, 0.0
        for r in sorted((r for r in items if r[0] == u), key=lambda r: (r[4], r[1])):
            if used > 0 and used + r[3] > 300:
                part, used = part + 1, 0.0
            used += r[3]
            want.append((u, r[1], part))
    assert got == sorted(want)


def test_turns(spark, tmp_path, items):
    keyed.prepare(spark)
    stream = keyed.turns(arrivals(spark, f"{tmp_path}/in", items, 3, 2), 2.0, "30 days")
    streams.append_log(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(240)
    got = sorted(((r.key, r.kind, round(r.start, 3), round(r.end, 3), r.n) for r in spark.read.schema("key long, kind string, start double, end double, n long").json(f"{tmp_path}/out").where("key < 99").collect()), key=repr)
    want = []
    for u in (1, 2, 3):
        for r in sorted((r for r in items if r[0] == u), key=lambda r: (r[4], r[1])):
            s = round(seconds(r[4]), 3)
            if want and want[-1][0] == u and want[-1][1] == r[2] and round(s - want[-1][3], 3) <= 2.0:
                want[-1] = (*want[-1][:3], s, want[-1][4] + 1)
            else:
                want.append((u, r[2], s, s, 1))
    assert got == sorted(want, key=repr)


def test_streams_of_many_files_are_the_batch(spark, tmp_path):
    """Files in no order of time, more than several batches of sixteen hold; rows of one bucket and a null key among them."""
    from quillstream.plans import catalog
    from tests.oracle import SF, connect, rows_of, rows_of_sql

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(70, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = connect()
    for name in ("streamed_windows", "streamed_sessions", "streamed_partitions", "streamed_turns"):
        assert rows_of(catalog.queries()[name](spark, str(tmp_path))) == rows_of_sql(con, catalog.oracle_sql()[name]), name


class _State:
    """A list or value state in memory, which counts its calls."""

    def __init__(self, calls):
        self.held, self.calls = None, calls

    def exists(self):
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def put(self, rows):
        self.calls.append("put")
        self.held = rows

    update = put

    def appendList(self, rows):
        self.calls.append("append")
        self.held = (self.held or []) + rows

    def clear(self):
        self.held = None


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getListState(self, name, schema):
        return _State(self.calls)

    getValueState = getListState

    def registerTimer(self, ms):
        self.calls.append("timer")
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_timers_and_calls_do_not_grow_with_the_items():
    import pandas as pd

    class Times:
        def getCurrentWatermarkInMs(self):
            return 5_000

    handle = _Handle()
    fold = keyed.OrderedFold("s double, id long, size double", "n long", ["key", "id"], lambda open_, x: (((open_ or (0,))[0] + 1,), [(x[1],)]), None)
    fold.init(handle)
    rows = [(7, k % 3 > 0, k % 3, k / 100, k, 1.0) for k in range(1000)]
    assert not list(fold.handleInputRows((7,), iter([pd.DataFrame(rows)]), Times()))
    assert handle.timers == {0} and len(handle.calls) < 5
    out = pd.concat(fold.handleExpiredTimer((7,), Times(), None))
    # an item is told when the watermark is above its millisecond
    assert sorted(out["id"]) == list(range(500)) and set(map(str, out["key"])) == {"None", "1", "2"} and 5_000 in handle.timers
    assert len(handle.calls) < 15
