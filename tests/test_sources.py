"""Scans, sinks, streams and calls of user functions."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.operators import external, select
from quillstream.sources import jsonl
from quillstream.streaming import turns as streams


def test_scans(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_bytes(b'{"k": "1", "v": "a"}\r\n\r\n{"k": "x", "v": "b"}\r\n{"k": "1", "v": "c"}\nnot json\n{"k": null, "v": "d"}\n')
    kinds = "k string, v string"
    assert sorted(r.v for r in jsonl.read_jsonl(spark, str(p), kinds, strict=False).collect()) == ["a", "b", "c", "d"]
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, str(p), kinds).collect()
    assert jsonl.read_jsonl(spark, str(tmp_path / "none"), kinds).count() == 0
    assert [(r.line, r._bad) for r in jsonl.located_errors(spark, str(p), kinds).collect()] == [(5, "not json")]
    with pytest.raises(ValueError, match="a.jsonl:5"):
        jsonl.read_checked(spark, str(p), kinds)
    assert [tuple(r) for r in jsonl.read_indexed(spark, str(p), kinds, "k").collect()] == [(1, "c")]
    s = tmp_path / "s.jsonl"
    s.write_text('{"total": 2}\n{"scene_index": 2}\n{"scene_index": 1}\n')
    assert [r.scene_index for r in jsonl.read_scenes(spark, str(s), "scene_index int, total int").collect()] == [1, 2]
    first, rest = jsonl.split_summary(jsonl.read_jsonl(spark, str(s), "scene_index int, total int"))
    assert first.first().total == 2 and rest.count() == 2
    s.write_text('{"scene_index": 2}\n{"total": 2}\n')
    with pytest.raises(Exception, match="no scene_index"):
        jsonl.read_scenes(spark, str(s), "scene_index int, total int").collect()
    (tmp_path / "c.json").write_text('{"a": ["x", "y"], "b": null}')
    assert sorted(map(tuple, jsonl.confirmations(jsonl.read_config(spark, str(tmp_path / "c.json"))).collect())) == [("a", "x"), ("a", "y")] and jsonl.read_config(spark, str(tmp_path / "z")).count() == 0


def test_images_events_registry(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "a.png").write_bytes(b"x" * 10)
    (tmp_path / "img" / "b.png").write_bytes(b"x" * 99)
    assert [r.length for r in jsonl.read_images(spark, str(tmp_path / "img"), str(tmp_path), 50).collect()] == [10]
    with pytest.raises(ValueError):
        jsonl.read_images(spark, str(tmp_path / "img" / ".." / ".." / "x"), str(tmp_path / "img"))
    lines = spark.createDataFrame([(1, 2, '{"event_type": "text", "text": "b"}'), (1, 1, '{"event_type": "text", "text": "a"}'), (1, 3, '{"event_type": "end"}'), (2, 1, "noise"), (2, 2, '{"event_type": "text", "text": "z"}')], "id int, at int, value string")
    assert sorted(map(tuple, jsonl.event_text(lines, ["id"], "at").collect())) == [(1, "ab", True), (2, "z", False)]
    names = spark.createDataFrame([(" one ",), (None,), ("",)], "name string")
    assert [r.name for r in jsonl.registry(names, "name", "all").collect()] == ["one"] and [r.name for r in jsonl.registry(names.limit(0), "name", "all").collect()] == ["all"]


def test_sinks(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "out")
    jsonl.write_jsonl(df, path, ["id"])
    jsonl.write_jsonl(df.where("id = 0"), path, append=True)
    assert spark.read.json(path).count() == 6
    bad = df.select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        jsonl.write_jsonl(bad, path)
    assert spark.read.json(path).count() == 6  # a failed write leaves the old folder
    jsonl.write_jsonl(df.limit(2), path)
    assert spark.read.json(path).count() == 2 and not [p for p in tmp_path.iterdir() if "old-" in p.name]
    table = str(tmp_path / "t")
    jsonl.rebuild(df, table)
    jsonl.rebuild(df.limit(1), table)
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(table + ".previous").count() == 5

    def refuse(new):
        raise ValueError("no")

    with pytest.raises(ValueError):
        jsonl.rebuild(df, table, refuse)
    assert spark.read.parquet(table).count() == 1
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    jsonl.upsert_file(spark, str(tmp_path / "u"), rows, ["id"])
    assert sorted(map(tuple, jsonl.upsert_file(spark, str(tmp_path / "u"), rows.where("id = 2").withColumn("v", F.lit("c")), ["id"]).collect())) == [(1, "a"), (2, "c")]
    (tmp_path / "u.lock").touch()
    with pytest.raises(BlockingIOError):
        jsonl.upsert_file(spark, str(tmp_path / "u"), rows, ["id"])
    # a lock that a crash has left behind goes after the lease
    assert jsonl.upsert_file(spark, str(tmp_path / "u"), rows, ["id"], lease=-1.0).count() == 2 and not (tmp_path / "u.lock").exists()


def test_reports(spark):
    rows = spark.createDataFrame([("b", 20, ["x/a.PNG?v=1", "note"]), ("a", 3, None)], "label string, n long, media array<string>")
    assert json.loads(jsonl.counts_json(rows, "label", "n").first().json) == {"a": 3, "b": 20}
    assert [r.path for r in jsonl.referenced(rows, ["media", "label"]).collect()] == ["x/a.PNG"]
    assert [r.value for r in jsonl.report(rows, [("label", "name", 6), ("n", "count", 3)], ["label"], "Counts").collect()] == ["Counts", "name   cou", "----------", "a      3  ", "b      20 "]


def test_inventory_changes(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    before = spark.createDataFrame(jsonl.inventory(spark, str(tmp_path)).collect(), "path string, length long, modificationTime timestamp")
    (tmp_path / "b.txt").write_text("yy")
    assert [r.length for r in jsonl.changed(jsonl.inventory(spark, str(tmp_path), "*.txt"), before).collect()] == [2]


def test_stream_of_turns(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, k, kind, at + datetime.timedelta(seconds=s)) for k, (kind, s) in enumerate([("a", 0), ("a", 5), ("b", 6), ("b", 30), ("a", 31)])] + [(2, 9, "a", at + datetime.timedelta(days=2))]
    df = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, ts timestamp")
    df.where("event_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("event_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.stream_parquet(spark, str(tmp_path / "in"), 1)
    streams.append_log(streams.turns(stream, 10.0), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    base = (at - datetime.datetime(1970, 1, 1)).total_seconds()
    got = sorted((r.kind, r.start - base, r.end - base, r.n) for r in spark.read.json(str(tmp_path / "out")).where("user = 1").collect())
    assert got[:3] == [("a", 0.0, 5.0, 2), ("a", 31.0, 31.0, 1), ("b", 6.0, 6.0, 1)] and ("b", 30.0, 30.0, 1) in got


def test_calls(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None), (4, "abc")], "id long, t string")
    got = {r.id: r.embedding for r in external.embed(rows, lambda ts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in ts]), "t").collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] is None and got[3] is None

    def ask(row):
        if row["id"] == 4:
            raise KeyError("never")
        if row["id"] == 2:
            raise TimeoutError("busy")
        return row["t"] or "none"

    got = {r.id: (r.answer, r.tries, r.error) for r in external.call(rows, ask, tries=2, terminal=(KeyError,)).collect()}
    assert got == {1: ("ab", 1, None), 2: (None, 2, "TimeoutError: busy"), 3: ("none", 1, None), 4: (None, 1, "KeyError: 'never'")}
    got = {r.id: r.answer and r.answer.k for r in external.call_json(rows, lambda row, bad: f'So: {{"k": {row["id"]}}}!' if row["id"] < 3 or bad else "nothing", "k int").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    out = external.staged(rows, [("look", lambda d: d.withColumn("confirmed", F.col("id") < 3)), ("make", lambda d: d.withColumn("t", F.lit("made")))], gate="look").collect()
    assert {r.id: (r.stage, r.t) for r in out} == {1: ("make", "made"), 2: ("make", "made"), 3: ("look", None), 4: ("look", "abc")}


def test_scores_and_questions(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 100.0), ([1.0, 0.0], [-1.0, 0.0], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], 0.0), ([1.0, 1.0], [1.0, 0.0], 100 * 0.5**0.5), ([1.0], [1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double").select("want", external.similarity_score(external.cosine_distance(F.col("a"), F.col("b"))).alias("got"))
    assert all(r.got == pytest.approx(r.want) for r in df.collect())
    questions = spark.createDataFrame([("CQ", None, 1, "What is {subject}?"), ("P", "person", 1, "Who is {subject}?"), ("P", "object", 2, "?")], "ladder string, kind string, place int, template string")
    subjects = spark.createDataFrame([("Ash", "person"), ("Bow", None)], "name string, kind string")
    got = sorted((r.name, r.ladder, r.question) for r in external.interview(subjects, questions, "name", "kind").collect())
    assert got == [("Ash", "CQ", "What is Ash?"), ("Ash", "P", "Who is Ash?"), ("Bow", "CQ", "What is Bow?")]


def test_requests(spark):
    df = spark.createDataFrame([(" ", None, 3), (None, "x", 11), ("a", None, None)], "a string, b string, k int")
    got = [r.errors for r in select.check_request(df, ["a", "b"], {"k": (1, 10)}).collect()]
    assert got == [["one of a, b is needed"], ["k must lie between 1 and 10"], []]


def test_query_texts(spark):
    from quillstream.operators import context

    df = spark.createDataFrame([("a", "", None), (None, None, "c"), ("a", "b", "c"), ("", None, None)], "x string, y string, z string")
    got = [tuple(r.q) for r in df.select(context.query_text([("X", F.col("x")), ("Y", F.col("y")), ("Z", F.col("z"))], ["X", "Y"]).alias("q")).collect()]
    assert got == [("X: a", "a"), ("Z: c", "Z: c"), ("X: a\nY: b\nZ: c", "a\nb"), ("", "")]


def test_polling(spark, tmp_path):
    seen = []

    def rebuild(files):
        seen.append(files.count())
        if len(seen) < 3:
            (tmp_path / "in").mkdir(exist_ok=True)
            (tmp_path / "in" / f"{len(seen)}.txt").write_text("x" * len(seen))

    assert jsonl.poll(spark, str(tmp_path / "in"), rebuild, 0.0, until=lambda n: n == 6) == 3 and seen == [0, 1, 2]


def test_scenes_with_a_tail(spark):
    from quillstream.operators import folds

    frames = lambda diffs: spark.createDataFrame([([(k, d) for k, d in enumerate(diffs)],)], "x array<struct<frame:long,diff:double>>").select(folds.scenes(F.col("x"), 5.0, 2, 2.0).alias("s")).first().s
    assert [tuple(s) for s in frames([0.0, 9.0, 9.0, 0.0, 0.0, 9.0, 0.0])] == [(1, 0, 1, 0.0, 1.0, 1.0), (2, 2, 4, 1.0, 2.5, 1.5), (3, 5, 6, 2.5, 3.5, 1.0)]
    assert [tuple(s)[:3] for s in frames([0.0, 0.0, 9.0])] == [(1, 0, 1)] and frames([]) == [] and frames([0.0]) == []


def test_needed_members(spark):
    from quillstream.operators import lookup

    arrays = spark.createDataFrame([(1, [5, 6]), (2, [6])], "o int, a array<int>")
    rows = spark.createDataFrame([(6,), (5,)], "v int")
    assert sorted(map(tuple, lookup.first_member(rows, arrays, "v", "a", "o", True).collect())) == [(5, 1), (6, 1)]
    with pytest.raises(Exception, match="no a holds 7"):
        lookup.first_member(rows.unionByName(spark.createDataFrame([(7,)], "v int")), arrays, "v", "a", "o", True).collect()


def test_repaired_json(spark):
    from quillstream.functions import text as T

    rows = ['Sure: {"t": 5, "l": "one", "n": "3.7", "u": 1}', '{"t": "x", "l": [1, {"a": 2}, "b"], "n": -4}', '{"t": null, "l": null, "n": "many"}', "none", None, '{"t": {"k": [1]}, "l": {"k": 1}}']
    df = spark.createDataFrame([(x,) for x in rows], "j string").select(T.repaired(F.col("j"), ["t"], ["l"], ["n"]).alias("r"))
    assert [tuple(r.r) for r in df.collect()] == [("5", ["one"], 3), ("x", ["1", '{"a":2}', "b"], 0), ("", [], 0), ("", [], 0), ("", [], 0), ('{"k":[1]}', ['{"k":1}'], 0)]


def test_neighbors_are_linked(spark):
    from quillstream.operators import lookup

    passages = spark.createDataFrame([(f"p{k}", "c1" if k < 7 else "c2", k) for k in range(10)], "passage string, group string, seq long")
    pairs = lambda xs: spark.createDataFrame([("e", x) for x in xs], "entity string, passage string")
    got = lookup.neighbor_passages(pairs(["p5", "p0"]), passages, pairs(["p3", "p4", "p6", "p7", "p9", "p2", "p1"]), pairs(["p9", "p4", "p8", "p5", "x"]), 2, 3)
    assert sorted((r.passage, r.place, r.near) for r in got.collect()) == [("p0", 1, "p1"), ("p0", 2, "p2"), ("p0", 3, "p4"), ("p5", 1, "p3"), ("p5", 2, "p4"), ("p5", 3, "p6")]
