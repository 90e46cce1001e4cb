"""Phrases, alignment and impact search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import alignment, impact_search, phrases

# --- phrases ---


def collocations_by_hand(rows, least, longest, top, share=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    known = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = defaultdict(list)
    for (lang, *w), a in known.items():
        around = [b for (x, *v), b in known.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= share * a for b in around):
            continue
        cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for lang, v in out.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def corpus(seed, docs=80):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "x", "ÀB", "a\x00b", " "]
    rows = []
    for k in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "\x0c ", "! "]) for _ in range(rng.randint(0, 40)))
        rows.append((k % 50, None if rng.random() < 0.05 else text, rng.choice(["en", "de", None, "und"])))
    return rows + [rows[3], rows[3], (None, "new york city " * 700, "en")]


@pytest.mark.parametrize("small", [False, True])
def test_phrases_are_brute_force(spark, monkeypatch, small):
    if small:  # several slices of words and of candidates, several tasks, a tree of sums
        for name, value in (("SLICE", 5), ("TASK", 200), ("FAN_IN", 2)):
            monkeypatch.setattr(phrases, name, value)
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"phrase": F.lit(1), "slots": F.lit(2), "f": F.lit(3)}).repartition(4)
    for least, top, share in ((5, 2000, 100), (30, 4, 60)):
        got = phrases.collocations(df, least, 5, top, share)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == collocations_by_hand([(r[2], r[1]) for r in rows], least, 5, top, share)


def test_no_phrases(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "a b", "en")], "doc_id long, text string, lang string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    assert [tuple(r) for r in phrases.collocations(df, 1).collect()] == [("en", 1, "a b", 1, 1, 1, 2, 2000)]


def test_scores_pass_64_bits(spark):
    row = spark.sql("select 4000000000000L as f, 9000000000000000L as n, array(8000000L, 4000000000000L) as heads, array(5000000L, 4000000000000L) as tails")
    assert row.select(F.expr(phrases.CUTS)[0]["score"]).first()[0] == 1000 * 4000000000000 * 9000000000000000 // (8000000 * 5000000)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 20_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
        h = phrases.Perfect(keys)
        slots = h.find(keys)
        assert sorted(slots.tolist()) == list(range(len(keys))) and (h.keys[slots] == keys).all()
        strangers = np.setdiff1d(rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64), keys)
        assert (h.find(strangers) == -1).all()


# --- alignment ---


def aligned_by_hand(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a_lib.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    bytes_a = lambda i: bytes(alphabet[c] for c in a_lib.id_to_token(i))
    bytes_b = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    seen, counts = [], Counter()
    for doc, text in rows:
        spans = []
        for ids, of in ((a_lib.encode(" " + text, add_special_tokens=False).ids, bytes_a), (b_lib.encode(text), bytes_b)) if text else ():
            at, own, whole = 0, [], b""
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at, whole = at + len(of(i)), whole + of(i)
            spans.append(own if whole == (" " + text).encode() else None)
        if not text or None in spans:
            seen.append((doc, 0, 0, [], []))
            continue
        a, b = spans
        links, first = [], 0
        for s, e, i in a:
            while b[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        groups, low = [], 0
        for cut in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            groups.append("|".join(",".join(str(i) for s, e, i in x if low < e <= cut) for x in (a, b)))
            low = cut
        counts.update(set(links))
        seen.append((doc, len(a), len(b), groups, links))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return sorted(((d, na, nb, len(g), len(x), sum(counts[y] == best[y[0]] for y in x), sum(counts[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g)) for d, na, nb, g, x in seen), key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  a  b "), (5, "a\nb\n\nc"), (6, "x\r\ny"), (7, "a▁b"), (None, "hi there"), (None, "hi there"), (8, "<|endoftext|> and <s> x"),
    (9, "é" * 50 + " 👍🏽 　z\t"), (10, "a\x0bb \x85 c\x1cd"), (11, "x" * 3000), (12, "don't can't 'll  's\n 's"), (13, "a\n b \n c"), (14, ";\r\n )\rx"), (15, "\nlead"), (16, "tail\n"),
    (17, "(end). e.g. .com 3.14, so... ?! 5. ok."), (18, "naïve Ünder. Ärger, ß! ɐ. ⅷ. ².,"), (19, "a​b ﻿ x\u0000y"), (20, "word " * 4000 + "end."),
]


@pytest.mark.parametrize("lot", [None, 40])
def test_alignment_is_brute_force(spark, monkeypatch, lot):
    if lot:
        monkeypatch.setattr(alignment, "LOT", lot)
    rng = random.Random(2)
    signs = ["a", "The", " ", " ", "\n", ".", ",", "!", "'s", "é", "9", "(", ")", "-", "ing", "\t", "  ", "日本", " "]
    rows = ODD + [(100 + k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lot": F.lit("x"), "n": F.lit(1), "groups": F.lit(2)}).repartition(3)
    got = alignment.align(df, written=True)
    assert sorted(map(tuple, got.collect()), key=repr) == aligned_by_hand(rows)
    assert alignment.align(df.limit(0)).count() == 0


def test_pair_counts(spark):
    df = spark.createDataFrame([(1, "the cat the cat"), (2, "the cat"), (3, None)], "doc_id long, text string").repartition(2)
    counts = alignment.pair_counts(alignment.aligned_lots(df)).collect()
    assert counts and {r.n for r in counts} == {2}


def test_links_pack_and_unpack():
    for doc, code, times, docs in (([], [], [], 0), ([], [], [], 3), ([0, 0, 2], [5, 9, 1], [1, 300, 70000], 4)):
        back = alignment.unpack_links(alignment.pack_links(*(np.array(x, np.int64) for x in (doc, code, times)), docs))
        assert [x.tolist() for x in back] == [doc, code, times]


# --- impact search ---


def best_by_hand(rows, asks, k):
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 2**20 for c in v)]
    out = []
    for a, (i, q) in enumerate(x):
        if i is not None and asks(i):
            scored = sorted((-sum(c * d for c, d in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(x) if b != a and len(v) == len(q))[:k]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("step", [1.0, 0.25, 0.001])
def test_search_is_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(impact_search, "SLICE", 7)
    rng = random.Random(3)
    vector = lambda: [rng.choice([0.0, -0.0, rng.randint(-1000, 1000) * step]) for _ in range(6)]
    rows = [(rng.randint(0, 60), vector()) for _ in range(150)]
    rows += [(100, rows[0][1])] * 40 + [(None, rows[0][1]), (None, None), (50, [0.0] * 6), (0, None), (10, []), (20, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (30, [float("nan")] * 6), (40, [float("inf")] + [0.0] * 5), (10, [1.0, 2.0]), (20, [0.5, -2.0]), (60, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit(1), "ids": F.lit(2), "asks": F.lit(3)}).repartition(4)
    got = impact_search.search(impact_search.impact_index(df, F.col("vec_id") % 10 == 0))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == best_by_hand(rows, lambda i: i % 10 == 0, 5)


def test_scores_beyond_doubles(spark):
    """Components so large that scores differ in their last digits only; blocks of three partitions hand the bound on."""
    rows = [(k, [float(2**19 + 2**18), float(k % 3) / 256, 524287.99609375 - (k % 2) / 256]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).coalesce(1)
    got = impact_search.search(impact_search.impact_index(df, F.col("vec_id") % 10 == 0))
    assert sorted(map(tuple, got.collect()), key=repr) == best_by_hand(rows, lambda i: i % 10 == 0, 5)


def test_search_without_rows(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    for rows in (df, df.limit(0), df.withColumn("vec_id", F.lit(None).cast("long"))):
        assert impact_search.search(impact_search.impact_index(rows, F.col("vec_id") % 10 == 0)).count() == 0
    assert impact_search.search(impact_search.impact_index(df, F.lit(True))).count() == 0


def test_search_stops_on_proof():
    """A query with one great component needs few postings where its best vectors stand out, and misses none."""
    rng = np.random.default_rng(4)
    v = rng.integers(-8, 8, (5000, 32)).astype(np.int32)
    v[rng.choice(5000, 20, replace=False), 0] = 4000
    order = np.argsort(-v, axis=0, kind="stable").T.astype(np.int16)
    block = impact_search.Block({"block": 0, "size": 5000, "dims": 32, "ids": np.arange(5000).tobytes(), "known": np.ones(5000, bool).tobytes(), "vectors": v.tobytes(), "order": np.ascontiguousarray(order).tobytes()})
    for q in (np.eye(32, dtype=np.int64)[0] * 900 + 1, v[17].astype(np.int64), np.zeros(32, np.int64)):
        at, score, work = block.best(q, 5, -np.inf, None)
        exact = v.astype(np.int64) @ q
        want = np.lexsort((np.arange(5000), -exact))[:5]
        assert at.tolist() == want.tolist() and score.tolist() == exact[want].tolist()
        if q[0] == 901:
            assert work < 500


# --- hot rows of earlier operators ---


def test_a_row_repeated_very_often_is_packed_in_many_tasks(spark, monkeypatch):
    from quillstream.llm import packing

    monkeypatch.setattr(packing, "SHARD", 2_000)
    monkeypatch.setattr(packing, "LOT", 500)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    hot = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"), F.lit(5).cast("long").alias("ids_crc32"))
    rows = hot.unionByName(spark.createDataFrame([(1, 0, 0, 1000, 9), (None, 0, 0, 24, 8), (2, 0, 0, 7, 5)], kind))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = packing.pack(rows)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = sorted((r.sequence_id, r.offset, r.length) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive[0])
        spark.conf.set("spark.sql.shuffle.partitions", adaptive[1])
    assert sum(sizes) == 100_003 and len(sizes) > 8 and max(sizes) < 30_000
    at = {}
    for seq, offset, length in got:
        assert offset == at.get(seq, 0)
        at[seq] = offset + length
    assert max(at.values()) <= 1024 and len(at) == -(-(100_001 * 7 + 1024) // 1024) or len(at) <= -(-100_001 // 146) + 1


@pytest.mark.parametrize("most", [2, 100_000])
def test_hot_groups_however_many(spark, monkeypatch, most):
    from quillstream.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "HOT", 3)
    monkeypatch.setattr(exact_dedup, "MOST_HOT", most)
    rows = [(k, f"T{k % 5}") for k in range(40)] + [(100 + k, "t0") for k in range(60)] + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = exact_dedup.exact_groups(df).collect()
    by = {}
    for i, x in rows:
        by.setdefault((x or "").lower(), []).append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == 6
    for r in got:
        own = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(own) and r.keep_id == min((i for i in own if i is not None), default=None)
