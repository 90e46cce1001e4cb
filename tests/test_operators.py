import random

from pyspark.sql import functions as F

from quillstream.functions import evidence
from quillstream.functions import text as T
from quillstream.operators import folds, intervals, media, records, search, select
from quillstream.plans import catalog
from quillstream.sources import jsonl
from quillstream.streaming import turns


def chunks(counts, target, most, overlap):
    out, start, n = [], 0, len(counts)
    while start < n:
        end, words = start, 0
        while end < n and (end == start or (words < target and words + counts[end] <= most)):
            words += counts[end]
            end += 1
        out.append((start, end - 1))
        if end >= n:
            break
        start = max(start + 1, end - overlap)
    return out


def test_word_budget_is_the_plain_loop(spark):
    rng = random.Random(5)
    cases = [[rng.randint(0, 40) for _ in range(rng.randint(0, 30))] for _ in range(120)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, c array<int>")
    for overlap in (0, 1):
        got = {r.k: [tuple(x) for x in r.x] for r in df.select("k", folds.word_budget(F.col("c"), 50, 70, overlap).alias("x")).collect()}
        assert got == {k: chunks(c, 50, 70, overlap) for k, c in enumerate(cases)}


def test_reconcile_keeps_the_longer_sentence_in_place(spark):
    rows = [(0.0, 5.0, "a"), (0.5, 5.5, "longer"), (1.2, 6.0, "c"), (9.0, 9.5, "d")]
    df = spark.createDataFrame([(rows,)], "x array<struct<start:double,end:double,sentence:string>>")
    out = [tuple(r) for r in df.select(folds.reconcile(F.col("x")).alias("x")).first()[0]]
    assert out == [(0.5, 5.5, "longer"), (9.0, 9.5, "d")]


def test_overlap_join_is_the_nested_loop(spark):
    rng = random.Random(2)
    items = [(k, a, a + rng.random() * 30) for k, a in enumerate(rng.random() * 100 for _ in range(60))]
    spans = [(k, a, a + rng.random() * 50) for k, a in enumerate(rng.random() * 100 for _ in range(40))]
    got = intervals.overlap_join(spark.createDataFrame(items, "i int, start double, `end` double"), spark.createDataFrame(spans, "j int, s double, e double"), 7.0)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((i, j) for i, a, b in items for j, s, e in spans if b >= s and a < e)


def test_scene_starts_keeps_a_least_length(spark):
    df = spark.createDataFrame([([(1, 50.0), (20, 50.0), (25, 90.0), (60, 10.0), (70, 31.0)],)], "x array<struct<frame:long,diff:double>>")
    assert df.select(folds.scene_starts(F.col("x"), 30.0, 15).alias("s")).first()[0] == [0, 20, 70]


def test_connected_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, 101), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in records.connected(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[k] == 0 for k in range(21)) and got[101] == 100 and got[202] == 200


def test_nested_upsert_and_update(spark):
    df = spark.createDataFrame([([("a", 1)],), (None,)], "x array<struct<k:string,v:int>>")
    new = F.struct(F.lit("a").alias("k"), F.lit(9).alias("v"))
    assert [[tuple(y) for y in r[0]] for r in df.select(records.nested_upsert(F.col("x"), new, "k")).collect()] == [[("a", 9)], [("a", 9)]]
    base, change = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string"), spark.createDataFrame([(1, None, "c"), (2, "d", None)], "k int, x string, y string")
    assert sorted(tuple(r) for r in records.update_fields(base, change, ["k"]).collect()) == [(1, "a", "c"), (2, "d", None)]


def test_text_functions(spark):
    df = spark.createDataFrame([("White Orus, Spirit-Fruit!", "Not specified", "one two three four")], "a string, b string, c string")
    r = df.select(T.slug(F.col("a")), T.has_value(F.col("b")), T.ellipsis_at_blank(F.col("c"), 10), T.ellipsis(F.col("c"), 8), T.url_path(F.lit("a b\\c.png")), T.compact_key(F.col("a"))).first()
    assert tuple(r) == ("white-orus-spirit-fruit", False, "one two…", "one two…", "a%20b/c.png", "whiteorusspiritfruit")


def test_jsonl_modes(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n{"a": oops}\n{"a": 3}\n')
    assert sorted(r.a for r in jsonl.read_jsonl(spark, str(p), "a long", strict=False).collect()) == [1, 3]
    assert jsonl.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0
    assert jsonl.located_errors(spark, str(p), "a long").count() == 1


def test_streaming_sessions(spark, tmp_path):
    sf = "/root/testdata/sf0.001/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(sf).schema).parquet(sf[: sf.rindex("/")] + "/events.parquet*")
    q = turns.sessions(events.withColumn("ts", F.col("ts").cast("timestamp"))).writeStream.format("memory").queryName("s").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from s").first()[0] == spark.read.parquet(sf).count()


def test_traits_need_support_near_the_anchor(spark):
    far = "Orla stood there. " + "x" * 300 + " silver hair"
    rows = [("silver hair", "ORLA had Silver hair", "silver hair"), ("silver", far, ""), ("hair", None, ""), ("the", "Orla", "the"), (None, "Orla", ""), ("", "Orla", "")]
    df = spark.createDataFrame([(v, e) for v, e, _ in rows], "v string, e string")
    got = [r.s for r in df.select(evidence.supported(F.col("v"), F.col("e"), ["Orla"], ["the"]).alias("s")).collect()]
    assert got == [want for *_, want in rows]


def test_repair_split_is_the_plain_loop(spark):
    def split(sizes, count):
        target, chunk, words, out = max(1, sum(sizes) // count), 0, 0, []
        for i, n in enumerate(sizes):
            if i and words + n > target and chunk + 1 < count:
                chunk, words = chunk + 1, 0
            words += n
            out.append(chunk)
        return out

    rng = random.Random(9)
    cases = [[rng.choice([0, 1, 5, 40]) for _ in range(n)] for n in (0, 1, 2, 7, 20)]
    df = spark.createDataFrame([(c,) for c in cases], "c array<int>")
    assert [r.s for r in df.select(media.repair_split(F.col("c"), 3).alias("s")).collect()] == [split(c, 3) for c in cases]


def test_quotes_of_any_cut_are_found(spark, tmp_path):
    docs = ["He said: \"one two\nthree four five six\" and left", "a seven eight nines ten", "x", "", None, "one two three four five six", "over\n\nand  over again it went"]
    quotes = ["one two\nthree four five six", "two\nthree", "wo\nthree four five si", "one two three four five six", "seven eight nine", "x", "", None, "er\n\nand  over again it wen", "eight nines ten"]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [(i, k) for i, q in enumerate(quotes) for k, x in enumerate(docs) if q is not None and x is not None and q in x]
    assert sorted(map(tuple, catalog.evidence_substring(spark, str(tmp_path)).collect())) == want


def test_pairs_of_all_blocks_are_the_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(60).collect()]
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, search.similar_pairs(df, "vec_id", "embedding", 0.2).collect()))
    assert got == sorted((a, b) for a, x in rows for b, y in rows if a < b and sum(p * q for p, q in zip(x, y)) >= 0.2) and got


def test_membership_covers_every_line(spark):
    sf = "/root/testdata/sf0.001"
    li, o = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "orders"))
    whole = li.join(o.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey")).count()
    assert catalog.array_membership(spark, sf).count() == whole


def test_first_span_of_a_point_makes_no_pairs(spark):
    rng = random.Random(8)
    spans = [(k, s := float(rng.randrange(60)), rng.choice([s, s + rng.randrange(9), s + 40, s - 2, float("nan")] if k % 9 == 0 else [s, s + rng.randrange(9)])) for k in range(80)]
    spans += [(90, None, 5.0), (91, 3.0, None), (92, 2e10, 4e10)]  # the last one is longer than any sequence of buckets
    points = [(k, k / 2) for k in range(-4, 140)] + [(500, None), (501, 3e10), (502, 1e10)]
    after = lambda a, b: b is not None and a is not None and (a != a or (b == b and b <= a))
    for some in (spans, [x for x in spans if x[2] == x[2]]):
        want = {}
        for i, p in points:
            held = [(s, k) for k, s, e in some if s is not None and e is not None and after(p, s) and after(e, p)]
            if held:
                want[i] = min(held)[1]
        got = select.at_point(spark.createDataFrame(points, "i long, at double"), spark.createDataFrame(some, "k long, s double, e double"), "at", "s", "e", ["s", "k"], 1.0)
        assert {r.i: r.k for r in got.collect()} == want and len(want) > 100


def test_linking_pairs_connect_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(search, "PACKED", 7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").limit(150).collect()]
    df = spark.createDataFrame([*rows, (999, None)], "vec_id long, embedding array<float>")
    for least in (0.25, 5.0):
        every, few = (f(df, "vec_id", "embedding", least) for f in (search.similar_pairs, search.linking_pairs))
        got, want = (sorted(map(tuple, records.connected(x).collect())) for x in (few, every))
        assert got == want and all(r.src < r.dst for r in few.collect())
    # one part of blocks: a pair for each connected vector but the first, not all pairs
    monkeypatch.setattr(search, "PARTS", 1)
    monkeypatch.setattr(search, "HELD", 100)
    assert search.linking_pairs(df, "vec_id", "embedding", 0.05).count() < 150 < search.similar_pairs(df, "vec_id", "embedding", 0.05).count()
