"""Many patterns in many texts, and operators whose earlier results were wrong."""

import random

from pyspark.sql import functions as F

from quillstream.functions.udfs import canonical_json
from quillstream.operators import context, lookup, mutate
from quillstream.operators.patterns import match_patterns, mentions


def test_patterns_are_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "ab" * 3000]
    patterns = ["".join(rng.choice("ab é") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", None, "ab", "ab"]
    t = spark.createDataFrame([(k, x, k % 7) for k, x in enumerate(texts)], "id long, text string, other int").repartition(5)
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    want = sorted((k, x) for k, text in enumerate(texts) if text is not None for x in {x for x in patterns if x is not None} if x in text)
    for shard in (10, 1_000_000):
        got = match_patterns(t, p, "p", "text", ["id"], shard=shard)
        assert sorted(map(tuple, got.collect())) == want
    assert match_patterns(t.limit(0), p, "p", "text").count() == 0 and match_patterns(t, p.limit(0), "p", "text").count() == 0
    assert match_patterns(t, p, "p", "text").columns == ["id", "text", "other", "pattern"]


def test_mentions_are_whole_words(spark):
    t = spark.createDataFrame([(1, "Orla's bow. MEI-LIN ran"), (2, "Orlando"), (3, None), (4, "orla orla")], "id long, text string")
    n = spark.createDataFrame([("Orla", "o"), (" mei-lin ", "m"), ("", "x"), (None, "y"), ("ran", "o")], "name string, k string")
    assert sorted(map(tuple, mentions(t, n, "name", "k", "text", ["id"]).collect())) == [(1, "m"), (1, "o"), (4, "o")]


def test_contains_join_keeps_named_columns(spark):
    t = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "id long, text string")
    q = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", ""), ("n", None)], "k string, q string")
    got = sorted(map(tuple, lookup.contains_join(q, t, "q", "text", keep=["id"]).collect()))
    assert got == sorted([(k, p, i) for i, s in ((1, "a b"), (1, "a b"), (2, "c")) for k, p in (("x", "a"), ("y", "a"), ("z", "")) if p in s])


def test_texts_leave_their_scan_only_when_hit(spark):
    t = spark.createDataFrame([(1, "a b")], "id long, text string")
    plan = lookup.contains_join(spark.createDataFrame([("a",)], "q string"), t, "q", "text", keep=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "substr" not in plan


def test_zip_of_empty_and_null_arrays(spark):
    rows = [([], []), ([1], []), (None, [1]), ([1, 2], [3]), ([None], [4])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").select(lookup.zip_arrays(F.col("a"), F.col("b"), ("x", "y")).alias("z"))
    assert [[tuple(p) for p in r.z] for r in df.collect()] == [[], [], [], [(1, 3)], [(None, 4)]]


def test_budget_holds_for_any_lengths(spark):
    rng = random.Random(3)
    rows = [tuple(None if rng.random() < 0.1 else "x" * rng.randint(0, 20) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for most in (0, 5, 17, 30):
        for before, r in zip(rows, df.select(context.fit_budget([F.col(c) for c in "abc"], list("abc"), most).alias("s")).collect()):
            sizes, old = [len(x or "") for x in r.s], [len(x or "") for x in before]
            assert sum(sizes) <= most and [x is None for x in r.s] == [x is None for x in before]
            assert sum(old) > most or sizes == old
            level = max(sizes)
            assert all(s == o or s == level for s, o in zip(sizes, old)) and (sum(old) <= most or most - sum(sizes) < 3)
    got = df.select(context.fit_budget([F.lit("x" * 10)] * 3, list("abc"), 5).alias("s")).first().s
    assert sum(map(len, got)) == 3


def test_even_trimming(spark):
    df = spark.createDataFrame([([("word " * 400, 1), ("short", 2), (None, 3)],)], "m array<struct<t:string,k:int>>")
    cut = lambda size, least: [tuple(x) for x in df.select(context.trim_evenly(F.col("m"), "t", F.lit("x" * size), 100, least).alias("m")).first().m]
    assert cut(100, 20)[0][0] == "word " * 400
    assert cut(101, 20) == [("word word word word…", 1), ("short", 2), ("", 3)]


def test_entities_match_inside_words_and_count_repeats(spark):
    e = spark.createDataFrame([("e", "Moon", ["a moonlit hall"], [1, 1, 2]), ("f", None, None, None), ("g", "x", [], [9])], "entity string, name string, descriptions array<string>, passage_ids array<long>")
    p = spark.createDataFrame([(1, "Moonlight on stone"), (2, None), (3, "moon")], "passage_id long, text string")
    got = {r.entity: (round(r.score, 6), r.citations) for r in context.entity_scores(e, p, ["moon", "lit", "x"]).collect()}
    # tokens in cited text: moon (in Moonlight); in descriptions moon, lit; in the name moon
    assert got == {"e": (round((1 + 4 + 3) / 3**0.5, 6), 3), "f": (0.0, 0), "g": (3.0, 1)}
    many = [f"t{k}" for k in range(100)] + ["moon"]
    assert {r.entity: r.score for r in context.entity_scores(e, p, many).collect()}["e"] == round((1 + 2 + 3) / 3**0.5, 9)


def test_json_keeps_letters(spark):
    assert spark.createDataFrame([('{"b": 1, "a": "é"}',)], "s string").select(canonical_json("s")).first()[0] == '{"a":"é","b":1}'


def test_both_copies_without_row_numbers(spark):
    scenes = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    chapters = spark.createDataFrame([("x", [(1, "a"), (2, "b")]), ("y", [(1, "a"), (2, "b")]), ("z", []), ("n", None), ("w", [(None, "c")])], "id string, s array<struct<k:long,v:string>>")
    own, whole = mutate.update_both(scenes, chapters, spark.createDataFrame([(1, "new")], "k long, v string"), "k", "s", ["v"])
    assert sorted(own.collect(), key=str) == sorted([(1, "new"), (2, "b"), (None, "c")], key=str)
    got = {r.id: None if r.s is None else [tuple(x) for x in r.s] for r in whole.collect()}
    assert got == {"x": [(1, "new"), (2, "b")], "y": [(1, "new"), (2, "b")], "z": [], "n": None, "w": [(None, "c")]}
    assert "monotonically" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_both_copies_of_arrays_in_any_order(spark):
    mixed = F.udf(lambda n: [(k, "old") for k in random.sample(range(int(n)), int(n))], "array<struct<k:long,v:string>>").asNondeterministic()
    chapters = spark.range(20).select("id", mixed(F.lit(12)).alias("s"))
    changes = spark.createDataFrame([(k, "new") for k in range(0, 12, 2)], "k long, v string")
    _, whole = mutate.update_both(changes, chapters, changes, "k", "s", ["v"])
    got = whole.collect()
    assert len(got) == 20 and all(sorted(map(tuple, r.s)) == [(k, "old" if k % 2 else "new") for k in range(12)] for r in got)


def test_ties_are_ordered(spark):
    now = spark.createDataFrame([(1, "now")], "k long, v string")
    prior = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (3, None)], "k long, v string").repartition(4)
    got = mutate.import_results(now, prior, ["k"], F.lit(True), {}, ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "now"), (2, "a"), (3, None)]
    got = mutate.inject(now, prior, ["k"], F.col("v").isNotNull(), [F.desc("v")])
    assert sorted(map(tuple, got.collect())) == [(1, "now"), (2, "b")]


def test_fuzzy_names_are_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    keys = [(word(), k) for k in range(60)]
    rows = [(k, word(), rng.choice([word(), None])) for k in range(120)] + [(200, None, None), (201, "", "x")]
    first = {}
    for key, order in keys:
        first[key] = min(order, first.get(key, order))
    want = {}
    for k, a, b in rows:
        near = [(o, x) for x, o in first.items() if a is not None and min(len(x), len(a)) >= lookup.GRAM and (x in a or a in x)]
        want[k] = (a, "first") if a in first else (b, "second") if b in first else (min(near)[1], "contained") if near else (None, None)
    got = lookup.fuzzy_cascade(spark.createDataFrame(rows, "id int, a string, b string"), spark.createDataFrame(keys, "key string, ord int"), "a", "b", "key", "ord").collect()
    assert {r.id: (r.key, r.how) for r in got} == want and len(got) == len(rows)
    assert {h for _, h in want.values()} == {"first", "second", "contained", None}


def test_neighbors_of_many_descriptions(spark):
    """Every passage describes one entity: what meets an anchor doesn't grow with them, and the first places are those of all of them."""
    passages = [(k, k // 9, k % 9) for k in range(900)]
    links = [("e", k) for k in range(900) if k % 3] + [("f", 4)]
    p, told = spark.createDataFrame(passages, "passage long, group long, seq long"), spark.createDataFrame([("e", k) for k in range(901)], "entity string, passage long")
    anchors = [("e", k) for k in range(900)]
    out = lookup.neighbor_passages(spark.createDataFrame(anchors, "entity string, passage long"), p, spark.createDataFrame(links, "entity string, passage long"), told)
    known, want = {k for e, k in links if e == "e"}, []
    for _, a in anchors:
        beside = [k for k in (a - 2, a - 1, a + 1, a + 2) if k // 9 == a // 9 and k in known]
        want += [(a, k, i) for i, k in enumerate((beside + [k for k in sorted(known) if k not in beside and k != a][:6])[:6], 1)]
    assert sorted((r.passage, r.near, r.place) for r in out.collect()) == sorted(want)
    near = spark.createDataFrame(links, "entity string, near long")
    assert sorted(map(tuple, lookup._first_told(told, near, p, 7).collect())) == [("e", k) for k in sorted(known)[:7]]
