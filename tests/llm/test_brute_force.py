"""Earlier operators and the pipeline's stages against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import line_dedup, mixing, registry, tokens
from tests.oracle import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return row[-1]


def test_line_classes_of_random_documents(spark):
    rng = random.Random(12)
    seeds = ["".join(rng.choice("abcé xyz") for _ in range(rng.choice([24, 25, 31, 40]))) for _ in range(6)] + ["short line", "ab", " ", "", "\t"]

    def bent(line):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randint(0, len(line))
            line = rng.choice([line[:at] + rng.choice("abq") + line[at:], line[:at] + line[at + 1 :], line[:at] + rng.choice("abq") + line[at + 1 :]])
        return line

    docs = [(k, "\n".join(bent(s) if len(s) > 20 else s for s in (rng.choice(seeds) for _ in range(rng.randint(0, 6))))) for k in range(40)]
    docs += [(None, docs[5][1]), (None, None), (50, docs[7][1])]
    lines = sorted({x for _, t in docs for x in (t or "").split("\n")})
    fits = [x for x in lines if len(x) >= line_dedup.LEAST_CHARS or (x and WORD.search(x))]
    long = [k for k, x in enumerate(fits) if len(x) >= line_dedup.LEAST_CHARS]
    root = dict(zip(fits, roots(len(fits), [(a, b) for i, a in enumerate(long) for b in long[i + 1 :] if distance(fits[a], fits[b], 2) <= 2])))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"line": F.lit("x"), "at": F.lit(1)}).repartition(3)
    got = {(r.doc_id, r.tkey): r for r in line_dedup.line_classes(df, least=1).collect()}
    keys = {r.text: r.k for r in spark.createDataFrame([(t or "",) for _, t in docs], "text string").distinct().select("text", F.xxhash64("text").alias("k")).collect()}
    seen, want = set(), {}
    for i, t in sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, d[0] or 0, keys[d[1]])):
        gone = []
        for at, x in enumerate(t.split("\n")):
            if x in root:
                gone += [at] if root[x] in seen else []
                seen.add(root[x])
        want[i, keys[t]] = (len(t.split("\n")), sum(x in root for x in t.split("\n")), gone)
    assert {k: (r.n_lines, r.n_eligible, r.removed) for k, r in got.items()} == want


def shares(sizes, cap=3):
    """Targets by bisection of the level at which all words are given out."""
    total, weights = sum(sizes), [1 + k % 3 for k in range(len(sizes))]
    low, high = 0.0, 10.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, cap * s) for w, s in zip(weights, sizes)) < total else (low, mid)
    return [min(low * w, cap * s) for w, s in zip(weights, sizes)]


def test_mixing_targets_and_sizes(spark):
    rng = random.Random(2)
    docs = [(k, None if k % 31 == 0 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))), rng.choice(["b", "a", "é", None, "Z", "tiny"] if k % 40 == 0 else ["b", "a", "é", None, "Z"])) for k in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = {r.doc_id: r for r in mixing.mix_copies(df).collect()}
    sizes, own = Counter(), {k: len(WORD.findall(t or "")) for k, t, _ in docs}
    for k, _, s in docs:
        sizes[s] += own[k]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shares([sizes[s] for s in order])))
    taken = Counter()
    for k, _, s in docs:
        r = rows[k]
        assert (r.size, r.source_size) == (own[k], sizes[s]) and r.target == pytest.approx(target[s], rel=1e-6) and 0 <= r.copies <= 3
        taken[s] += r.copies * own[k]
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)  # one document's words
    assert sorted(map(tuple, mixing.mix_copies(df.repartition(2)).collect()), key=repr) == sorted(map(tuple, rows.values()), key=repr)


def test_held_out_is_the_checksum(spark):
    for r in registry.queries()["op2_language_id"](spark, SF).select("doc_id", "held_out").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline_by_stages(spark):
    """Each stage's rows, written and read again, against what brute force makes of its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = [tuple(r) for r in docs.collect()]

    def step(name):
        out = stages[name](spark, spark.createDataFrame(rows, docs.schema), SF)
        return out.columns, [tuple(r) for r in out.collect()]

    # rules: nobody comes in, texts only lose lines, and who fails the base rules is gone
    columns, kept = step("quality_rules")
    before = {r[0]: dict(zip(names, r)) for r in rows}
    assert columns == names and 0 < len(kept) <= len(rows)
    at = names.index("text")
    for r in kept:
        lines = iter((before[r[0]]["text"] or "").split("\n"))
        assert all(any(x == y for y in lines) for x in r[at].split("\n"))
    verdict = {r.doc_id: r.kept for r in registry.queries()["op10_quality_lines"](spark, SF).collect()}
    assert {r[0] for r in kept} == {k for k, v in verdict.items() if v}

    # exact copies: the least id of each text
    rows = kept
    columns, kept = step("exact_dedup")
    first = {}
    for r in sorted(rows):
        first.setdefault(lower(r[at]), r)
    assert columns == names and sorted(kept) == sorted(first.values())

    # near copies: the least id of each component
    rows = sorted(kept)
    columns, kept = step("near_dedup")
    sets = [shingles(r[at]) for r in rows]
    by = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            by[x].add(k)
    near = {(a, b) for k, s in enumerate(sets) for x in s for a, b in [(min(k, o), max(k, o)) for o in by[x] if o != k]}
    links = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(len(rows), links)
    assert columns == names and sorted(kept) == [r for k, r in enumerate(rows) if root[k] == k]

    # mixing: rows as they were, three times at most, each source near its target
    rows = sorted(kept)
    columns, kept = step("mixing")
    copies, size = Counter(kept), {r: len(WORD.findall(r[at])) for r in rows}
    src = names.index("source")
    order = sorted({r[src] for r in rows}, key=lambda s: (s is None, s or ""))
    target = shares([sum(size[r] for r in rows if r[src] == s) for s in order])
    assert columns == names and set(copies) <= set(rows) and max(copies.values()) <= 3
    for s, goal in zip(order, target):
        assert abs(sum(n * size[r] for r, n in copies.items() if r[src] == s) - goal) <= max(size[r] for r in rows if r[src] == s)

    # packing: every id of every copy has one place
    rows = kept
    _, packed = step("packing")
    ids = {r[0]: np.frombuffer(x, np.uint32).tolist() + [tokens.END_ID] for r, x in zip(rows, tokens.encoder(None).encode([r[at] for r in rows]))}
    want = Counter()
    for r in rows:
        want[r[0], len(ids[r[0]])] += 1
    found, ends = Counter(), {}
    for doc, _, start, length, crc, seq, offset in sorted(packed, key=lambda r: (r[5], r[6])):
        assert offset == ends.get(seq, 0) and crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        ends[seq] = offset + length
        found[doc] += length
    assert max(ends.values()) <= 1024 and found == Counter({doc: n * k for (doc, n), k in want.items()})
    free = []  # best-fit decreasing, piece by piece
    for n in sorted((r[3] for r in packed), reverse=True):
        fit = [k for k, x in enumerate(free) if x >= n]
        if fit:
            free[min(fit, key=free.__getitem__)] -= n
        else:
            free.append(1024 - n)
    assert len(ends) <= len(free)


def test_url_verdicts_of_odd_tables(spark):
    from quillstream.llm import url_filter

    kind = "page_id long, url string, host string, path string, rule int, verdict string"
    pages = spark.createDataFrame([(1, "http://A.Example.com/en/7x?q", "h", "p", 1, "v"), (1, "http://A.Example.com/en/7x?q", "h", "p", 1, "v"), (None, None, None, None, None, None), (3, "", "h", None, 2, None), (4, "no scheme", "h", "p", 3, "v"), (5, "x://", "h", "p", 3, "v"), (6, "ftp://com#en/", "h", "p", 3, "v"), (7, "https://com/en/" + "a/" * 5000, "h", "p", 3, "v")], kind)
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    key = lambda df: sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    allow = lambda i, host, path: (i, host, path, None, "allow")
    want = [(1, "a.example.com", "/en/7x", "example.com/en/7", "allow")] * 2 + [allow(None, "", ""), allow(3, "", ""), allow(4, "", ""), allow(5, "", ""), allow(6, "com", ""), (7, "com", "/en/" + "a/" * 5000, "com/en/", "block")]
    assert key(url_filter.judge_urls(pages, rules)) == sorted(want, key=repr)
    assert key(url_filter.judge_urls(pages.limit(0), rules)) == []
    assert key(url_filter.judge_urls(pages, rules.limit(0))) == sorted([(*r[:3], None, "allow") for r in want], key=repr)


def test_near_lines_of_one_template(spark, monkeypatch):
    """Groups far above PAIRED: the links connect what brute force connects, and are few."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([2, 5, 9]))) for _ in range(14)]
    lines = set()
    while len(lines) < 150:
        own = list(words)
        for at in rng.sample([2, 3, 9], 2):
            own[at] = "".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 3, 4])))
        lines.add(" ".join(own))
    lines |= {f"{'x' * 20}{a}{b}{'y' * 20}" for a in "abcdefghij" for b in "klmnop"}
    lines = sorted(lines)
    want = roots(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if distance(lines[i], lines[j], 2) <= 2])
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    at = {hashlib.md5(x.encode()).digest(): k for k, x in enumerate(lines)}
    for paired in (16,):
        monkeypatch.setattr(line_dedup, "PAIRED", paired)
        found = [(at[bytes(r.a)], at[bytes(r.b)]) for r in line_dedup.near_lines(df).collect()]
        assert all(distance(lines[a], lines[b], 2) <= 2 for a, b in found)
        assert roots(len(lines), found) == want
        assert len(found) < 60 * len(lines)


def test_lines_that_differ_in_one_segment_meet_once(spark, monkeypatch):
    """Lines of a small group agree under every cut that skips the one segment in which they differ; one of these cuts counts."""
    kept = []
    monkeypatch.setattr(line_dedup, "durable", lambda df, f=line_dedup.durable: kept.append(f(df)) or kept[-1])
    base = "abcd efgh ijkl mnop qrst uvwx yzab cdef"
    for at in (0, 9, 20, 39):
        kept.clear()
        lines = [base[:at] + c + base[at:] for c in "xyz"]
        text = spark.createDataFrame([(0, k, x, 0) for k, x in enumerate(lines)], "g long, h long, line string, turns int")
        pairs, again = line_dedup._meeting(text, 2)
        assert sorted(map(tuple, pairs.collect())) == [(0, 1), (0, 2), (1, 2)]
        assert kept[-1].count() == 3 and again.isEmpty()
