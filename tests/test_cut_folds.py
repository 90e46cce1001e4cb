"""Folds of hot groups in parts, running values in stretches, cached calls."""

import os
import random

from pyspark.sql import functions as F

from quillstream.operators import external, folds, intervals
from quillstream.sources import versioned


def test_reconciled_parts_are_the_fold(spark):
    rng = random.Random(2)
    rows = []
    for u in (1, 2, None):
        at = 0.0
        for _ in range(120):
            at += rng.choice([0, 0.25, 0.75, 0.76, 5, 4000])
            rows.append((u, at, at + rng.choice([1, 2, 2.5, 4]), "x" * rng.randint(0, 4)))
    df = spark.createDataFrame(rows, "u int, start double, end double, sentence string").repartition(6)
    got = sorted(map(tuple, intervals.reconciled(df, ["u"], width=10.0).collect()), key=repr)
    want = df.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("start", "end", "sentence"))).alias("x")).select("u", F.explode(folds.reconcile(F.col("x"))).alias("x")).select("u", "x.*")
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) < len(rows)
    assert intervals.reconciled(df.limit(0), ["u"]).count() == 0


def test_a_hot_user_runs_in_many_tasks(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("u"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1).alias("end"), F.lit("x").alias("sentence"))
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = intervals.reconciled(df, ["u"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert sum(r["count"] for r in sizes) == 1_000_000 and len(sizes) == 16 and max(r["count"] for r in sizes) < 100_000


def test_running_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None]), float(rng.randint(-50, 50)), rng.choice([None, rng.randint(0, 99)]), k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, at double, v int, n int")
    for how, back in (("max", False), ("min", True)):
        order = [F.desc("at"), "n"] if back else ["at", "n"]
        got = {r.n: r.r for r in intervals.running(df, ["k"], "at", 7.0, order, "v", "r", how, back).collect()}
        for k in ("a", None):
            seen = []
            for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1] if back else r[1], r[3])):
                seen += [r[2]] if r[2] is not None else []
                assert got[r[3]] == ((max if how == "max" else min)(seen) if seen else None)


def test_second_run_makes_no_call(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, None), (5, "fail", 0)], "id long, q string, k int").repartition(3)
    log = f"{tmp_path}/calls"

    def ask(request):
        with open(log, "a") as f:
            f.write(f"{request['q']}\n")
        if request["q"] == "fail":
            raise KeyError("no")
        return f"{request['q']}!"

    def run(version=1):
        got = {r.id: (r.answer, r.error) for r in external.cached_call(rows, ["q", "k"], ask, f"{tmp_path}/cache", version=version, terminal=(KeyError,)).collect()}
        asked = sorted(open(log).read().split("\n")[:-1]) if os.path.exists(log) else []
        open(log, "w").close()
        return got, asked

    want = {1: ("a!", None), 2: ("a!", None), 3: ("b!", None), 4: ("None!", None), 5: (None, "KeyError: 'no'")}
    assert run() == (want, ["None", "a", "b", "fail"])
    assert run() == (want, ["fail"])
    assert versioned.read(spark, f"{tmp_path}/cache").count() == 3
    assert run(2) == (want, ["None", "a", "b", "fail"])


def test_parts_of_long_keys_are_the_fold(spark):
    rng = random.Random(8)
    rows = []
    for u, n in (("a", 150), (None, 40), ("b", 1), ("z", 12)):
        at = 0.0
        for k in range(n):
            at += rng.choice([0, 1, 3, 50])
            rows.append((u, at, k, 0 if u == "z" else rng.choice([0, 0, 1, 4, 9, 10, 25, None])))
    df = spark.createDataFrame(rows, "u string, at double, k int, size long").repartition(4)
    for budget in (10, 1, 1000):
        got = {(r.u, r.k): r.part for r in intervals.budget_parts(df, ["u"], "at", 20.0, ["at", "k"], "size", budget).collect()}
        assert len(got) == len(rows)
        for u in ("a", None, "b", "z"):
            part, used = 0, 0
            for r in sorted((r for r in rows if r[0] == u), key=lambda r: (r[1], r[2])):
                if used > 0 and used + (r[3] or 0) > budget:
                    part, used = part + 1, 0
                used += r[3] or 0
                assert got[u, r[2]] == part, (budget, r)
