"""Operators on small fixtures: brute force, round trips, nulls, ties, repeats, empty tables, clashing columns."""

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import common, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_lines, range_coder, registry, tokens, url_filter, warc
from tests.oracle import SF, connect, rows_of, rows_of_sql

LONG = "one two three four five six seven eight nine ten eleven twelve " * 3


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, copies, repeated rows, and columns whose names clash."""
    rows = [(0, LONG, "en", "a", 1), (1, LONG.upper(), "en", "a", 1), (1, LONG.upper(), "en", "a", 1), (2, None, None, None, None), (3, "", "de", "b", 0), (4, " \n\t ", None, "b", 3), (None, LONG, "en", None, 5), (5, "x", "fr", "c", 1), (6, LONG * 200, "en", "a", 9)]
    return spark.createDataFrame([(*r, 7, "z", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, h int, kept string, size double")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    assert rows_of(registry.queries()[name](spark, SF)) == rows_of_sql(connect(), registry.oracle_sql()[name])


def everything(docs):
    return {
        "exact": exact_dedup.exact_groups(docs), "near": ngram_join.near_duplicates(docs), "mix": mixing.mix_copies(docs), "mixed": mixing.mixed_documents(docs), "pack": packing.pack_documents(docs),
        "quality": quality_lines.quality_rules(docs, with_text=True), "lines": line_dedup.dedup_lines(docs), "lang": language_id.identify(docs, steps=20), "stay": exact_dedup.exact_dedup(docs), "one": ngram_join.one_of_each(docs), "good": quality_lines.kept_documents(docs),
    }


def test_odd_rows(spark, odd):
    out = {k: v.collect() for k, v in everything(odd).items()}
    n = odd.count()
    assert len(out["exact"]) == len(out["near"]) == len(out["mix"]) == len(out["quality"]) == len(out["lines"]) == len(out["lang"]) == n
    assert sum(r.kept for r in out["exact"]) == len(out["stay"]) == 5  # LONG, blank, x, the long text, and null with empty
    near = {r.doc_id: r.component_id for r in out["near"]}
    assert near[0] == near[1] == near[None] == 0 and near[3] == 3 and near[2] == 2
    assert {r.lang_pred for r in out["lang"] if r.doc_id in (2, 3, 4)} == {"und"}
    assert out["stay"][0].asDict().keys() == set(odd.columns)


def test_empty_tables(spark, odd):
    for name, df in everything(odd.limit(0)).items():
        assert df.count() == 0, name


def test_near_duplicates_are_the_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 90]))] for _ in range(25)]
    docs = []
    for k in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((k, " ".join(w)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for k, t in docs for w in [t.split()]}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_copies_of_shared_and_null_ids(spark):
    rng = random.Random(6)
    text = lambda n=60: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    near = lambda w: [*w[:-1], "changed"]
    a, b, c = text(), text(), text()
    clean = [text() for _ in range(6)]
    rows = [(1, a), (None, near(a)), (None, clean[0]), (None, clean[1]), (2, near(a)), (2, clean[2]), (None, b), (None, near(b)), (None, b), (3, c), (3, clean[3]), (4, near(c)), (4, clean[4]), (4, clean[5])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    for part in (1, 3):
        left = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs.repartition(part)).collect()]
        got = set(left)
        assert {(None, " ".join(clean[0])), (None, " ".join(clean[1])), (2, " ".join(clean[2])), (3, " ".join(clean[3])), (4, " ".join(clean[4])), (4, " ".join(clean[5])), (1, " ".join(a)), (3, " ".join(c))} < got
        assert len(left) == len(got) == 9 and len(got & {(None, " ".join(b)), (None, " ".join(near(b)))}) == 1


def test_tokens_of_every_text_of_an_id():
    import pyarrow as pa

    words = [" ".join(f"{x}{k}" for k in range(9)) for x in "ab"]
    sets = list(ngram_join.shingle_sets(pa.array(words)))
    want = ngram_join.digest(sets[1])
    batch = pa.RecordBatch.from_pydict({"text": [*words, words[1]], "gid": [b"g"] * 3, "chunk": [0] * 3, "asks": [True] * 3, "sid": [want] * 3})
    assert sum((r.column("sid").to_pylist() for r in ngram_join._tokens(5, False)([batch])), []) == [want]


def test_bounds_open_every_group_with_a_link():
    import pandas as pd

    rng = np.random.default_rng(3)
    pool, opened, linked = rng.integers(1, 2**63, 400).astype(np.uint64), 0, 0
    for _ in range(300):
        base = rng.choice(pool, rng.integers(1, 40), replace=False)
        near = lambda: np.unique(np.append(rng.choice(base, rng.integers(1, len(base) + 1), replace=False), rng.choice(pool, rng.integers(0, 5))))
        members, query = [near() for _ in range(3)], near()
        rows = pd.DataFrame({"sid": [bytes([k]) for k in range(3)], "tokens": [ngram_join._half(m).tobytes() for m in members]})
        group = ngram_join._union((b"g",), rows).assign(asks=False, sid=None)
        asks = pd.DataFrame({"gid": [None], "sid": [b"q"], "tokens": [ngram_join._half(query).tobytes()], "asks": [True], "least": [None], "most": [None]})
        opens = len(ngram_join._bound(75)((b"g", 0), pd.concat([group, asks[group.columns]], ignore_index=True))) > 0
        link = any(100 * len(np.intersect1d(m, query)) >= 75 * len(np.union1d(m, query)) for m in members)
        assert opens or not link
        opened, linked = opened + opens, linked + link
    assert linked < opened < 250


def test_near_duplicates_whatever_is_hot(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(50)}" for _ in range(60)]
    docs = []
    for k in range(120):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        docs.append((k, " ".join(w)))
    docs += [(200 + k, " ".join(base)) for k in range(30)] + [(300 + k, None) for k in range(5)] + [(400 + k, f"tiny text {k % 3}") for k in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.near_duplicates(df).collect()))
    stay = sorted(map(tuple, ngram_join.one_of_each(df).collect()), key=repr)
    for name, value in (("HOT_COPIES", 2), ("HOT_CLUSTERS", 1), ("GROUP", 2), ("QUERIES", 2), ("HOT", 1), ("BROADCAST_ROWS", 0), ("BROADCAST_SETS", 0), ("UNIONS", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect()), key=repr) == stay


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near_pairs(rng, n, sizes):
    for _ in range(n):
        a = "".join(rng.choice("abcé") for _ in range(rng.choice(sizes)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "z", "é"])
        yield a, "".join(b)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_are_the_reachable_nodes(spark, monkeypatch, few):
    """In one task and by shuffles: paths, stars, loops, repeated edges and null ends, against brute force."""
    monkeypatch.setattr(common, "FEW_EDGES", few)
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, x) for x in range(10, 60)] + [(60, 61), (61, 60), (60, 61), (5, 5), (None, 3), (3, None), (200, 150), (160, 150), (160, 200)]
    of = {x: {x} for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    for a, b in edges:
        if a in of and b in of:
            of[a] |= of[b]
            for x in of[a]:
                of[x] = of[a]
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in found) == sorted((x, min(c)) for x, c in of.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_banded_distance(spark):
    pairs = list(near_pairs(random.Random(1), 600, [0, 1, 2, 3, 6, 14, 40]))
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        assert [r.w for r in df.select(line_dedup.within(F.col("a"), F.col("b"), k).alias("w")).collect()] == [edit(a, b) <= k for a, b in pairs]


def test_line_join_is_the_brute_force(spark):
    lines = sorted({x for p in near_pairs(random.Random(3), 60, [24, 25, 30, 61]) for x in p if len(x) >= line_dedup.LEAST_CHARS})
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in line_dedup.near_lines(spark.createDataFrame([(x,) for x in lines * 2], "line string")).collect()}
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).digest()
    assert got == {frozenset((md5(a), md5(b))) for a in lines for b in lines if a < b and edit(a, b) <= 2}


def test_line_dedup_keeps_the_first(spark):
    a, b = "the quick brown fox jumps over the dog", "the quick brown fox jumped over the dog"
    docs = spark.createDataFrame([(2, f"{b}\nshort"), (1, f"{a}\nshort\n{a}")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} == {1: f"{a}\nshort", 2: "short"}


def test_short_lines_repeat_by_equality(spark):
    docs = spark.createDataFrame([(1, "Les.\n\n \nLes!\nLes."), (2, "Les.\n\n \nx\nLes!")], "doc_id long, text string")
    got = {r.doc_id: (r.n_eligible, list(r.removed), r.n_near) for r in line_dedup.line_classes(docs, least=1).collect()}
    assert got == {1: (3, [4], 0), 2: (3, [0, 4], 0)}
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, least=1).collect()} == {1: "Les.\n\n \nLes!", 2: "\n \nx"}


def test_warc_round_trip_and_assembly(spark, tmp_path):
    html = "é" * 80 + "\r\n\r\nWARC/1.1\r\n"
    pages = spark.createDataFrame([(3, "http://a.b/c?d#e", html), (1, "http://x", html), (9, None, None), (4, "u", "tiny"), (5, "u", "tiny"), (3, "http://a.b/c?d#e", html)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_and_assemble(pages, str(tmp_path / "w")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    n = len(html.encode())
    assert got == sorted([(1, n, "response", None), (3, n, "revisit", 1), (3, n, "revisit", 1), (4, 4, "response", None), (5, 4, "response", None), (9, 0, "response", None)], key=lambda r: r)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    assert records.count() == 18 and bytes(records.where("record_type = 'response' and target_uri = 'http://x'").first().payload) == html.encode()
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    told = records.where("record_type = 'revisit'").select("refers_to").distinct().collect()
    assert len(told) == 1 and records.where(F.col("record_id") == told[0][0]).first().record_type == "response"
    none = pages.limit(0).withColumn("id", F.lit(1)).withColumn("digest", F.lit("x"))
    assert warc.archive_and_assemble(none, str(tmp_path / "none")).count() == 0
    clash = pages.withColumn("id", F.lit("x")).withColumn("digest", F.lit("x")).withColumn("payload", F.lit(1))
    assert sorted(map(tuple, warc.archive_and_assemble(clash, str(tmp_path / "c")).select("page_id", "payload_bytes", "record_type", "refers_to").collect())) == got


def test_repeated_responses_are_found_by_digest(spark, tmp_path):
    html = "z" * 200
    pages = spark.createDataFrame([(1, "a", html), (1, "a", html), (2, "b", html), (None, "c", html)], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.archive_and_assemble(pages, str(tmp_path / "w")).select("page_id", "record_type", "refers_to").collect()), key=repr)
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1)]


def test_foreign_archives(spark, tmp_path):
    import gzip

    def record(kind, rid, to=(), block=b"x", more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n" + "".join(f"WARC-Concurrent-To: {x}\r\n" for x in to) + f"{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    chain = [record("metadata", "m9", ["m8"]), record("metadata", "m8", ["q7"]), record("request", "q7", ["r1"]), record("response", "r1", block=b"A" * 400_000)]
    several = [record("metadata", "m1", ["r2", "r3"], more="X-Folded: a\r\n b\r\n"), record("response", "r2"), record("response", "r3"), record("request", "q3", ["r3"])]
    named = [record("response", "r4", ["q4"]), record("request", "q4"), record("request", "q5", ["lost"]), record("metadata", "m5", ["lost"]), record("response", "r6"), record("warcinfo", "w", block=b""), record("metadata", "m6", ["m6", "r6"])]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(map(gzip.compress, chain + several)))
    (tmp_path / "two.warc").write_bytes(b"".join(named))
    got = {r.capture_id: (r.response and r.response.record_id, [x.record_id for x in r.requests], [x.record_id for x in r.metadata], [x.record_id for x in r.others]) for r in warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()}
    assert got == {"r1": ("r1", ["q7"], ["m8", "m9"], []), "r2": ("r2", ["q3"], ["m1"], ["r3"]), "r4": ("r4", ["q4"], [], []), "m5": (None, ["q5"], ["m5"], []), "r6": ("r6", [], ["m6"], []), "w": (None, [], [], ["w"])}
    assert warc.read_warc(spark, str(tmp_path / "a")).where("record_id = 'r1'").first().block_bytes == 400_000
    with pytest.raises(ValueError):
        list(warc.parse(gzip.compress(chain[0])[:-9]))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(k, "w " * rng.randint(1, 400), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix_copies(docs).collect()
    assert sorted(rows) == sorted(mixing.mix_copies(docs.repartition(7)).collect())
    by = {}
    for r in rows:
        assert 0 <= r.copies <= 3
        by.setdefault((r.source, r.target), []).append(r.size * r.copies)
    assert all(abs(sum(v) - target) <= 401 for (_, target), v in by.items())
    assert mixing.targets([10, 10, 80], [1, 2, 3]) == [pytest.approx(100 / 6), 30, pytest.approx(100 * 5 / 6 - 30)] or sum(mixing.targets([10, 10, 80], [1, 2, 3])) == pytest.approx(100)


def test_packing_places_every_piece_once(spark):
    rows = packing.pack_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == list(np.cumsum([0, *(n for _, n in v)])[:-1]) and sum(n for _, n in v) <= packing.CAPACITY
    for v in docs.values():
        v.sort()
        assert [s for s, _ in v] == list(np.cumsum([0, *(n for _, n in v)])[:-1]) and all(n == packing.CAPACITY for _, n in v[1:])
    assert len(by) <= 1.02 * sum(r.length for r in rows) / packing.CAPACITY + 2


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


def test_encoder_is_the_library():
    rng, lib, enc = random.Random(2), library(), tokens.Encoder(tokens.default_tokenizer())
    odd = ["", " ", "a  b\n\n c", "don't I'LL '", "<|endoftext|> x", "12³ ½ x_y--z", "\tx\r\n", "日本語 テスト", "a\0b", "😀 👩\u200d👩\u200d👧", " İx", "word " * 50]
    atoms = [" ", "  ", "\n", "\n\n", "\t", "\v", "\f", "\r\n", "\xa0", "\u3000", "\u2028", "\x1c", "\x85", "a", "word", "é", "Él", "日本", "١", "12", "½", ",", ".", "'s", "don't", "<|endoftext|>", "😀", "\u200b", "\0", "x.", "--", "I'LL"]
    odd += ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    for _ in range(2):  # the second time from memory
        assert [np.array(e.ids, np.uint32).tobytes() for e in lib.encode_batch(odd, add_special_tokens=False)] == enc.encode(odd)
    assert enc.encode([None]) == [b""]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_REMEMBERED", 64)
    monkeypatch.setattr(tokens, "CHARS", 50)
    enc, texts = tokens.Encoder(tokens.default_tokenizer()), [f"word{k} other{k % 7}, " + "x y " * (k % 3) for k in range(300)] + ["wide " * 30_000] + [" ".join(f"w{k}" for k in range(500))]
    assert enc.encode(texts) == [np.array(e.ids, np.uint32).tobytes() for e in library().encode_batch(texts, add_special_tokens=False)]


def test_encoder_is_a_freshly_loaded_library():
    from tokenizers import Tokenizer

    lib, end = Tokenizer.from_file(tokens.default_tokenizer()), "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"x{end}y", f"  {end}\n\n {end} z", "<|endoftext", f"{end[:-1]}{end}", "plain words"]
    assert lib.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    assert [np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts] == tokens.Encoder(tokens.default_tokenizer()).encode(texts)


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (1, 2, 700, 2048)] + [np.full(2048, 7, np.uint16), np.empty(0, np.uint16), np.tile(np.arange(30, dtype=np.uint16), 60)]
    coded = range_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded, [len(b) for b in blocks]), blocks))
    assert len(coded[4]) < 300
    whole = range_coder.pack_block(0, 0, blocks[2], [(1, 0, 700)], coded[2])
    with pytest.raises(ValueError):
        list(range_coder.documents_of(whole[:-3] + b"\0\0\1"))
    wide = np.array([1, 70_000, 2**32 - 1, 5], np.uint32)
    (words,) = range_coder.encode_blocks([range_coder.symbols_of(wide)])
    ((_, doc, ids),) = range_coder.documents_of(range_coder.pack_block(0, 0, wide, [(9, 0, 4)], words))
    assert doc == 9 and (ids == wide).all()


def test_range_coder_rounds_and_cost():
    """Runs of unequal length, all escapes and none; a long block costs far less than a call of numpy for each of its ids."""
    rng = np.random.default_rng(1)
    for n in (255, 256, 511, 513, 769, 5_000, 70_001):
        for ids in (rng.zipf(1.3, n) % 50_000, rng.integers(0, 65536, n), rng.integers(0, 2, n) * 65535):
            (coded,) = range_coder.encode_blocks([ids.astype(np.uint16)])
            assert (range_coder.decode_blocks([coded], [n])[0] == ids).all()
    # an id is followed by one of eight; 6.5 bits without contexts
    ids = np.zeros(1 << 19, np.int64)
    for k, x in enumerate(rng.integers(0, 8, len(ids))):
        ids[k] = (ids[k - 1] * 13 + x * 9 + 5) % 90
    began = time.process_time()
    (coded,) = range_coder.encode_blocks([ids.astype(np.uint16)])
    (back,) = range_coder.decode_blocks([coded], [len(ids)])
    assert (time.process_time() - began) / len(ids) < 700e-9
    assert (back == ids).all() and 8 * len(coded) / len(ids) < 6.5


def ids_of(texts):
    return [np.array([*e.ids, 2], np.uint32) for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_file_round_trip(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    monkeypatch.setattr(range_coder, "SHARDS", 2)
    range_coder.write_ids(docs, str(tmp_path / "ids"), shard_bytes=50_000)
    assert len(list((tmp_path / "ids").glob("part-*"))) > 4
    for got in (range_coder.query(spark, SF), range_coder.read_ids(spark, str(tmp_path / "ids"))):
        start = 0
        for r, d, ids in zip(sorted(got.collect()), rows, ids_of([d.text for d in rows]), strict=True):
            assert tuple(r) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)


def test_ids_of_odd_rows(spark, odd, tmp_path):
    range_coder.write_ids(odd, str(tmp_path / "ids"), shard_bytes=2_000)
    got = range_coder.read_ids(spark, str(tmp_path / "ids")).collect()
    want = [(r.doc_id, len(i), zlib.crc32(i.tobytes())) for r, i in zip(odd.collect(), ids_of([r.text for r in odd.collect()]))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_tokens, r.ids_crc32)) for r in got)
    at = sorted((r.start, r.n_tokens) for r in got)
    assert [a for a, _ in at] == list(np.cumsum([0, *(n for _, n in at)])[:-1]) and got[0].start >= 0
    range_coder.write_ids(odd.limit(0), str(tmp_path / "none"))
    assert range_coder.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_packed_ids_are_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: i for r, i in zip(docs.collect(), ids_of([r.text for r in docs.collect()]))}
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))
    assert all(zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_gradients_are_the_differences():
    rng = np.random.default_rng(1)
    f = lambda *s: rng.normal(size=s) * 0.3
    h = language_id.HIDDEN
    m = language_id.Model(["a", "b", "c"], [f(256, 3 * h) for _ in range(2)], [f(h, 3 * h) for _ in range(2)], [f(h, 3) for _ in range(2)], f(3))
    x, y = rng.integers(97, 101, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(m.run(x)[0][:, np.arange(4), y]).mean()
    for p, g in zip(m.params(), m.gradients(x, y)):
        at = tuple(rng.integers(n) for n in p.shape)
        at = (97, *at[1:]) if p.shape[0] == 256 else at
        old = p[at]
        p[at] = old + 1e-4
        up = loss()
        p[at] = old - 1e-4
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-4 - g[at]) < 1e-4


def test_line_rules_by_join_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("one"))
    few = quality_lines.Limits(min_docs=2, share=0.01)
    a, b = (sorted(map(tuple, quality_lines.quality_rules(docs, limits=few, with_text=True, broadcast_lines=n).collect())) for n in (100_000, 0))
    assert a == b and sum(r[-1] is False for r in a) > 0


def test_documents_of_shared_lines_are_counted_apart(spark):
    menu = "\n".join(f"menu entry number {k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"{menu}\nown{k}", "a") for k in range(60)] + [(60 + k, "a copy of one text", "a") for k in range(60)], "doc_id long, text string, source string")
    got = {r.line_n: r["count"] for r in quality_lines.common_lines(docs, "source", "text", quality_lines.Limits()).groupBy(F.col("n_docs").alias("line_n")).count().collect()}
    assert got == {60: 40}


def test_documents_of_one_header_and_footer(spark):
    docs = spark.createDataFrame([(k, f"the header line\nown line {k} of the host\nthe footer line", "a") for k in range(2000)], "doc_id long, text string, source string")
    got = sorted(r.n_docs for r in quality_lines.common_lines(docs, "source", "text", quality_lines.Limits()).collect())
    assert got == [2000, 2000]


def test_stages_keep_clashing_columns(spark):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, words, "a", "mine", 5, 7, 8, 9), (2, None, None, None, None, 1, 2, 3)], "doc_id long, text string, source string, kept string, n_words int, sha int, times int, copies int")
    for stay in (quality_lines.kept_documents, exact_dedup.exact_dedup, ngram_join.one_of_each, mixing.mixed_documents):
        got = [tuple(r) for r in stay(docs).collect()]
        assert set(got) >= {(1, words, "a", "mine", 5, 7, 8, 9)} and stay(docs).columns == docs.columns, stay


def test_hot_groups_of_copies(spark, monkeypatch):
    rows = [(k, "Same text") for k in range(40)] + [(3, "same TEXT"), (3, "same TEXT"), (None, "same text")] + [(100 + k, f"own {k}") for k in range(20)] + [(200, "two"), (201, "TWO"), (202, None), (203, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = key(exact_dedup.exact_groups(docs, keep="largest"))
    assert len(want) == len(rows) and sum(r[3] for r in want) == 23 and {r[1] for r in want if r[2] == 43} == {39}
    for hot, most in ((5, 100), (5, 0), (1, 100)):
        monkeypatch.setattr(exact_dedup, "HOT", hot)
        monkeypatch.setattr(exact_dedup, "MOST_HOT", most)
        assert key(exact_dedup.exact_groups(docs, keep="largest")) == want


def test_targets_by_table(spark, monkeypatch):
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, "w " * rng.choice([0, 1, 5, 400]), rng.choice([None, *(f"s{j}é" for j in range(40))])) for k in range(400)], "doc_id long, text string, source string")
    key = lambda: sorted((r.source or "", r.source_size, round(r.target, 6)) for r in mixing.mix_copies(docs).collect())
    want = key()
    monkeypatch.setattr(mixing, "DRIVER_SOURCES", 3)
    assert key() == want


def test_the_last_fraction_is_drawn():
    got = [mixing.pivot(np.array([0.2]), np.array([10.0]), np.random.default_rng(k), True)[0] for k in range(2000)]
    assert set(got) == {0.0, 1.0} and 0.17 < np.mean(got) < 0.23


def test_language_windows_are_the_network():
    rng = np.random.default_rng(1)
    h = language_id.HIDDEN
    f = lambda *s: (rng.normal(size=s) * 0.5).astype(np.float32)
    m = language_id.Model(["a", "b", "c"], [f(256, 3 * h) for _ in range(2)], [f(h, 3 * h) for _ in range(2)], [f(h, 3) for _ in range(2)], f(3))
    raw = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (1, 7, 60, language_id.CORE, language_id.CORE + language_id.LAP)]
    whole = [m.run(np.frombuffer(x, np.uint8)[:, None])[0][:, 0] for x in raw]
    got = language_id.Predictor(m).windows(raw)
    assert np.allclose(got[:4], [p.sum(0) for p in whole[:4]], atol=1e-3) and np.allclose(got.sum(1), [len(x) for x in raw], atol=1e-2)
    long = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    assert np.abs(language_id.Predictor(m).windows([long])[0] - m.run(np.frombuffer(long, np.uint8)[:, None])[0][:, 0].sum(0)).max() < 20


def test_language_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, f"der text {k} und so weiter und weiter", "de") for k in range(40)] + [(7, "the same text again and again", "en")] * 40 + [(8, "…", "en"), (9, None, "en")], "doc_id long, text string, lang string")
    got = language_id.identify(docs, steps=30, sample=5).collect()
    assert len(got) == 82 and {r.lang_pred for r in got if r.doc_id in (8, 9)} == {"und"} and {r.held_out for r in got if r.doc_id is None} <= {False, None}


def test_url_rules_with_many_rules(spark, monkeypatch):
    rules = spark.createDataFrame([("com", "/a", "block"), ("x.com", "/a/b", "allow"), (None, "/", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://y.com/abc"), (2, "HTTP://X.COM/a/bc?q"), (3, None), (4, "nothing"), (5, "http://xcom/a"), (2, "HTTP://X.COM/a/bc?q")], "page_id long, url string")
    want = [(1, "com/a", "block"), (2, "x.com/a/b", "allow"), (2, "x.com/a/b", "allow"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow")]
    for n in (url_filter.BROADCAST_RULES, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", n)
        assert sorted(map(tuple, url_filter.judge_urls(pages, rules).select("page_id", "rule", "verdict").collect()), key=repr) == sorted(want, key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == names
    assert docs.count() > 0
