"""Stored indexes: the full-text one equals a scan and reads fewer blocks, the vector one's recall is measured."""

import math
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F
from quillstream.operators import fulltext, ivf, search
from quillstream.plans import catalog
from tests.oracle import SF


def test_block_max_search_is_the_scan(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 30))) for _ in range(600)]
    texts[100] = "w40 w40 w40 w41 w41"
    docs = spark.createDataFrame([(k, x, "extra") for k, x in enumerate(texts)], "id long, text string, terms string").repartition(3)
    fulltext.build(docs, f"{tmp_path}/a", "id", "text", width=16)
    lots = [["w40", "w41"], ["w0"], ["w0", "w1", "w50", "w50"], ["none"], [], None, ["w59", "w3"]]
    questions = spark.createDataFrame(list(enumerate(lots)), "question long, terms array<string>")
    found, read = fulltext.search(spark, f"{tmp_path}/a", questions, 5)
    tf = [Counter(x.split()) for x in texts]
    avg = sum(sum(c.values()) for c in tf) / len(tf)
    want = []
    for q, terms in enumerate(lots):
        score = Counter()
        for w in set(terms or ()):
            df = sum(w in c for c in tf)
            for k, c in enumerate(tf):
                if w in c:
                    score[k] += math.log(1 + (len(tf) - df + 0.5) / (df + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
        best = sorted(((-round(s, 9), k) for k, s in score.items()))[:5]
        want += [(q, k, -s, r + 1) for r, (s, k) in enumerate(best)]
    assert sorted((r.question, r.id, r.score, r["rank"]) for r in found.collect()) == sorted(want)
    blocks = fulltext.bounds(spark, f"{tmp_path}/a", questions)
    rare = lambda df: df.where("question = 0").count()
    assert read.count() < blocks.count() and rare(read) < rare(blocks)
    assert read.count() == read.distinct().count()
    one, _ = fulltext.search(spark, f"{tmp_path}/a", questions.where("question = 0"), 5)
    scan = search.top(search.bm25(docs, ["w40", "w41"], "id"), 5)
    assert [(r.id, r.score) for r in one.orderBy("rank").collect()] == [(r.id, r.score) for r in scan.orderBy("rank").collect()]


def test_index_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    questions = spark.createDataFrame([(1, ["a"])], "question long, terms array<string>")
    for k, df in enumerate((docs, docs.limit(0))):
        fulltext.build(df, f"{tmp_path}/{k}")
        assert fulltext.search(spark, f"{tmp_path}/{k}", questions, 3)[0].count() == 0


def test_recall_of_lists(spark):
    rows = catalog.queries()["ivf_neighbors"](spark, SF).collect()
    v = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    unit = {k: x / np.linalg.norm(x) for k, x in v.items()}
    hits = total = 0
    for q in (k for k in v if k % 20 == 0):
        exact = sorted((-round(float(unit[q] @ x), 9), k) for k, x in unit.items() if k != q)[:10]
        mine = [r for r in rows if r.vec_id == q]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, len(mine) + 1))
        own = {r.neighbor for r in mine} & {k for _, k in exact}
        assert all(r.exact == (r.neighbor in own) for r in mine) and all(abs(r.recall - len(own) / 10) < 1e-9 for r in mine)
        hits, total = hits + len(own), total + 10
    assert hits / total >= 0.9


def test_lists_of_odd_vectors(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    c = ivf.build(df, f"{tmp_path}/a")
    asked = ivf.usable(df, "vec_id", "embedding").where("id = 1")
    got = ivf.neighbors(spark, f"{tmp_path}/a", c, asked, 3, 99).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(2, 1.0), (2, 1.0), (3, 0.0)]
    assert ivf.build(df.limit(0), f"{tmp_path}/b").size == 0
    assert ivf.neighbors(spark, f"{tmp_path}/b", np.zeros((0, 0)), asked, 3, 1).count() == 0


def test_exact_neighbors_leave_few_rows_to_rank(spark, tmp_path, monkeypatch):
    """A task tells each question's best, not those of every block; ties go to the smaller id, whatever is held."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(120)
    df = df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1000)).unionByName(df.withColumn("vec_id", F.col("vec_id") + 2000))
    c = ivf.build(df, f"{tmp_path}/a", lists=40)
    asked = ivf.usable(df, "vec_id", "embedding").where("id % 10 = 0")
    v = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in ivf.usable(df, "vec_id", "embedding").collect()}
    want = {q.id: [i for _, i in sorted((-round(float(v[q.id] @ x), 9), i) for i, x in v.items() if i != q.id)][:5] for q in asked.collect()}
    for kept in (1 << 21, 3):
        monkeypatch.setattr(ivf, "KEPT", kept)
        for found in (ivf.exact_neighbors(spark, f"{tmp_path}/a", asked, 5), ivf.neighbors(spark, f"{tmp_path}/a", c, asked, 5, len(c))):
            got = {}
            for r in found.orderBy("question", "rank").collect():
                got.setdefault(r.question, []).append(r.id)
            assert got == want
    monkeypatch.setattr(ivf, "KEPT", 1 << 21)
    best = ivf._Best(2)
    for k in range(50):
        assert not list(best.add(np.arange(3), np.arange(10) + 10 * k + 5, np.random.default_rng(k).random((3, 10))))
    assert sum(b.num_rows for b in best.rest()) == 6
    assert ivf.exact_neighbors(spark, f"{tmp_path}/none", asked, 5).count() == 0


def test_index_keeps_rows_of_one_id_apart(spark, tmp_path):
    """Repeated and missing ids are documents of their own; letters beyond a-z, capitals and empty texts as the SQL cuts them; one block a term and range."""
    rows = [(1, "Ab é1b ab"), (1, "ab"), (None, "x"), (None, "x x"), (3, None), (4, ""), (5, "K9 k9é"), (6, "-ab"), (7, "ab-")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    fulltext.build(docs, f"{tmp_path}/i", width=4)
    blocks = spark.read.parquet(f"{tmp_path}/i/postings")
    assert blocks.count() == blocks.select("term", "range").distinct().count()
    assert {r.term: r.df for r in spark.read.parquet(f"{tmp_path}/i/terms").collect()} == {"ab": 4, "1b": 1, "x": 2, "k9": 1}
    stats = spark.read.parquet(f"{tmp_path}/i/stats").first()
    assert (stats.docs, stats.avg_n) == (9, 11 / 9)
    questions = spark.createDataFrame([(1, ["ab"]), (2, ["x"])], "question long, terms array<string>")
    found = fulltext.search(spark, f"{tmp_path}/i", questions, 5)[0].collect()
    assert sorted((r.question, r.id or 0) for r in found) == [(1, 1), (1, 1), (1, 6), (1, 7), (2, 0), (2, 0)]


def test_hydrate_has_more_tasks_for_more_rows(spark, monkeypatch):
    """What a task holds follows HELD, not the number of shuffle partitions; rows without children and children without a row too."""
    from quillstream.operators import context

    monkeypatch.setattr(context, "HELD", 50)
    rows = spark.range(120).withColumnRenamed("id", "k")
    items = spark.range(600).select((F.col("id") % 130 + 5).alias("k"), F.col("id").alias("x"))
    got = context.hydrate(rows, "k", {"items": (items, ["x"], [], None)})
    assert got.rdd.getNumPartitions() == 12
    assert {r.k: [i.x for i in r["items"]] for r in got.collect()} == {k: [x for x in range(600) if x % 130 + 5 == k] for k in range(120)}
