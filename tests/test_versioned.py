"""Versioned tables and located scans of files cut into many ranges."""

import threading

import pytest
from pyspark.sql import functions as F

from quillstream.sources import jsonl, versioned


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(versioned, "FILE_ROWS", 50)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_merge_rewrites_touched_files_only(spark, tmp_path, small_files):
    path = f"{tmp_path}/t"
    base = spark.range(0, 1000, 2).select("id", F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("n"))
    assert versioned.replace(base, path, "id") == 1
    files = versioned.manifest(spark, path)["files"]
    assert len(files) >= 8 and all(a["high"] < b["low"] for a, b in zip(files, files[1:])) and sum(f["rows"] for f in files) == 500
    changes = spark.createDataFrame([(10, "new", None), (11, "added", 3), (-5, "low", 4)], "id long, v string, n int")
    version, rewritten = versioned.merge(changes, path, "id")
    assert (version, rewritten) == (2, 1)
    want = {r.id: (r.v, r.n) for r in base.collect()} | {10: ("new", None), 11: ("added", 3), -5: ("low", 4)}
    assert {r.id: (r.v, r.n) for r in versioned.read(spark, path).collect()} == want
    assert rows_of(versioned.read(spark, path, 1)) == rows_of(base)
    kept = {f["path"] for f in files} & {f["path"] for f in versioned.manifest(spark, path)["files"]}
    assert len(kept) == len(files) - 1
    # fields that are null stay; far keys touch the ends only
    version, rewritten = versioned.merge(spark.createDataFrame([(10, None, 7), (5000, "far", 1)], "id long, v string, n int"), path, "id", fields=True)
    want |= {10: ("new", 7), 5000: ("far", 1)}
    assert rewritten == 2 and {r.id: (r.v, r.n) for r in versioned.read(spark, path).collect()} == want
    versioned.merge(spark.createDataFrame([(10, None, None, True), (77777, None, None, True)], "id long, v string, n int, gone boolean"), path, "id", deleted="gone")
    want.pop(10)
    assert {r.id: (r.v, r.n) for r in versioned.read(spark, path).collect()} == want
    made = versioned.manifest(spark, path)["files"]
    assert all(a["high"] < b["low"] for a, b in zip(made, made[1:]))
    assert versioned.vacuum(spark, path, 1) > 0 and len(versioned.read(spark, path).collect()) == len(want)


def test_two_writers(spark, tmp_path, small_files):
    path = f"{tmp_path}/t"
    versioned.replace(spark.range(200).select("id", F.lit("old").alias("v")), path, "id")
    met, done = threading.Barrier(2), []

    def write(k):
        first = [True]

        def wait():  # both have written their files before either commits
            if first[0]:
                first[0] = False
                met.wait(60)

        done.append(versioned.merge(spark.createDataFrame([(k, f"w{k}"), (100 + k, f"w{k}")], "id long, v string"), path, "id", before_commit=wait)[0])

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    for x in threads:
        x.start()
    for x in threads:
        x.join(120)
    assert sorted(done) == [2, 3]
    got = {r.id: r.v for r in versioned.read(spark, path).collect()}
    assert len(got) == 200 and {k: v for k, v in got.items() if v != "old"} == {1: "w1", 101: "w1", 2: "w2", 102: "w2"}


def test_readers_never_miss_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    frames = [spark.createDataFrame([(k, v) for k in range(5)], "id long, v long").coalesce(1).cache() for v in range(2)]
    versioned.replace(frames[0], path, "id")
    stop, seen, wrong = threading.Event(), [], []

    def look():
        while not stop.is_set():
            try:
                seen.append({r.v for r in versioned.read(spark, path).collect()})
            except Exception as e:  # noqa: BLE001
                wrong.append(e)
                return

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(50):
        versioned.replace(frames[(k + 1) % 2], path, "id")
    stop.set()
    reader.join(60)
    assert not wrong and seen and all(len(s) == 1 for s in seen) and versioned.versions(spark, path)[-1] == 51


def test_odd_merges(spark, tmp_path, small_files):
    path = f"{tmp_path}/t"
    with pytest.raises(KeyError):
        versioned.read(spark, path)
    rows = spark.createDataFrame([("é", 1), ("", 2), ("b", None)], "k string, n int")
    assert versioned.merge(rows, path, "k") == (1, 0)
    assert versioned.merge(rows.limit(0), path, "k") == (1, 0)
    assert versioned.merge(spark.createDataFrame([("a", 3), ("zz", 4)], "k string, n int"), path, "k")[0] == 2
    assert {r.k: r.n for r in versioned.read(spark, path).collect()} == {"é": 1, "": 2, "b": None, "a": 3, "zz": 4}
    for bad in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            versioned.merge(spark.createDataFrame(bad, "k string, n int"), path, "k")
    versioned.replace(rows.limit(0), path, "k")
    assert versioned.read(spark, path).count() == 0
    assert versioned.merge(rows, path, "k")[0] == 4 and versioned.read(spark, path).count() == 3


def test_lines_of_a_file_in_many_ranges(spark, tmp_path):
    lines = [f'{{"id": {k}, "v": "é{"x" * (k % 40)}"}}' for k in range(400)]
    for k in (7, 123, 399):
        lines[k] = f'{{"id": {k}, broken'
    lines[50] = "   "
    (tmp_path / "a.jsonl").write_text("\n".join(lines[:200]) + "\n" + "\r\n".join(lines[200:]), "utf-8", newline="")
    (tmp_path / "b.jsonl").write_text("\n\n" + lines[7], "utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 8
        bad = {(r.file.rsplit("/", 1)[1], r.line, r._bad) for r in jsonl.located_errors(spark, str(tmp_path), "id long, v string").collect()}
        assert bad == {("a.jsonl", k + 1, lines[k]) for k in (7, 123, 399)} | {("b.jsonl", 3, lines[7])}
        got = {(r.line, r.value) for r in jsonl.numbered_lines(spark, str(tmp_path / "a.jsonl")).collect()}
        assert got == {(k + 1, x) for k, x in enumerate(lines) if x.strip()}
        with pytest.raises(ValueError, match="a.jsonl:8: "):
            jsonl.read_checked(spark, str(tmp_path / "a.jsonl"), "id long, v string")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
