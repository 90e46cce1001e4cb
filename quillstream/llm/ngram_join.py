"""N-gram Jaccard join with a token-group matrix.

A document's set is its distinct word shingles. Similar sets are partitioned into groups of bounded size; of
each group the union of its tokens is stored, a query set's overlap with the union bounds its similarity to
every member, and only groups whose bound qualifies are opened, that is, have their members fetched. The result is exact: which groups a query is
bounded against comes from the prefix filter, which loses no pair (two sets of similarity t or more share one
of the first |x| - ceil(t|x|) + 1 tokens of either, in any order common to all sets).

Steps, none of which emits the pairs within a group of similar sets:
1. sets: one narrow row per document; equal sets collapse to one class.
2. clusters: connected classes form a cluster, cut into groups of about GROUP members. Clusters grow in a few
   rounds: of the clusters that share a min-hash band the largest leads, and members of the others are compared with one
   group of it. This only shapes the groups; whatever it misses the next steps find.
3. postings: tokens of each set's prefix, rare shingles first, packed into binary blocks by token range.
   Only tokens found in two clusters or more leave, as (token, cluster) after map-side aggregation.
4. matrix: clusters that share a prefix token, and whose sizes and positions allow a link, are candidates.
   Members of the smaller cluster are bounded against the stored unions of the larger one's groups. Of the groups that
   qualify, and of no others, the members are compared: first the one of best bound of each two clusters, then the
   others of those clusters that aren't connected by now.
5. components over all verified links.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, WORD, batches, components, durable, release, shingle_sets, table, trim

WIDTH, PERCENT = 5, 75
BANDS, BINS = 8, 32
#: Members of a group, about, and queries that a task holds against it; tokens of either, about, where sets are long.
GROUP, QUERIES, TOKENS = 64, 256, 1 << 20
#: Unions that a task holds.
UNIONS = 64
#: Rounds of growing clusters, at most.
ROUNDS = 2
#: The most frequent shingles that the order of tokens knows, over all blocks: a table of 12 bytes each. Any order
#: is right; a table of bounded size only decides how many candidates it leaves.
FREQUENT, LEAST_DF = 1 << 20, 8
#: Tokens of a block of counts or postings, about; there are as many blocks as that needs, FREQUENT at most.
BLOCK = 400_000
#: Tables of up to so many rows are broadcast, after they were counted; larger ones meet in a shuffle.
BROADCAST_ROWS, BROADCAST_SETS = 20_000, 250_000
#: Sets with a frequent token beyond this count leave the packed postings one by one, salted.
HOT = 1 << 15
#: A set with more documents is hot, and a token with more clusters: the one is broadcast, the other dealt to several tasks.
HOT_COPIES, HOT_CLUSTERS = 1_000, 2_000

_SETS = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n", pa.int64()), ("sid", pa.binary()), ("bands", pa.list_(pa.int64()))])


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def short(sid: bytes) -> int:
    return int.from_bytes(sid[:8], "big", signed=True)


def bands_of(tokens: np.ndarray) -> list[int]:
    """One-permutation min-hashes (the least token of each of BINS ranges), BINS / BANDS of them to a band."""
    at = np.searchsorted(tokens, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    end = np.append(at[1:], len(tokens))
    mins = np.where(at < end, tokens[np.minimum(at, len(tokens) - 1)], np.uint64(0))
    per = BINS // BANDS
    return [xxhash.xxh3_64_intdigest(mins[k * per : (k + 1) * per].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def _sets(width: int):
    def run(it):
        def f(cols):
            out = {n: [] for n in _SETS.names} | {n: cols[n] for n in ("doc_id", "tkey")}
            for s in shingle_sets(cols["text"], width):
                out["n"].append(len(s))
                out["sid"].append(digest(s) if len(s) else None)
                out["bands"].append(bands_of(s) if len(s) else None)
            return out

        yield from batches(it, _SETS, f)

    return run


def _packed(blocks: int, tokens: np.ndarray, *planes: np.ndarray):
    """(block, bytes) for tokens sorted by value: within its block a token is its next 32 bits."""
    span = (1 << 64) // blocks + 1
    block = (tokens // np.uint64(span)).astype(np.int64)
    inner = ((tokens % np.uint64(span)) >> np.uint64(max(0, span.bit_length() - 32))).astype(np.uint32)
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
    for a, b in zip(starts, np.append(starts[1:], len(block))):
        step = np.diff(inner[a:b], prepend=np.uint32(0))
        yield int(block[a]), b"".join([np.uint32(b - a).tobytes(), *(step.view(np.uint8).reshape(-1, 4)[:, k].tobytes() for k in range(4)), *(p[a:b].tobytes() for p in planes)])


def _unpacked(blob: bytes, *kinds):
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    step = np.frombuffer(blob, np.uint8, 4 * n, 4).reshape(4, n).T.copy().view(np.uint32).ravel()
    out, at = [np.cumsum(step, dtype=np.uint32)], 4 + 4 * n
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_BLOBS = pa.schema([("block", pa.int64()), ("blob", pa.binary())])


def _emit(rows):
    rows = list(rows)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=_BLOBS)


def _distinct_sets(it, width: int):
    """Sets of a task, equal ones once."""
    seen = set()
    for b in it:
        for s in shingle_sets(b.column(0), width):
            if len(s) and (sid := digest(s)) not in seen:
                seen.add(sid)
                yield s, sid


def _count(width: int, blocks: int):
    def run(it):
        held, n = [], 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            yield from _emit(_packed(blocks, values, *((times >> 8 * k & 255).astype(np.uint8) for k in range(4))))

        for s, _ in _distinct_sets(it, width):
            held.append(s)
            n += len(s)
            if n >= BLOCK:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()
        held.clear()
        trim()

    return run


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return start, np.diff(np.append(start, len(sorted_)))


def _tally(most: int):
    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(x, *[np.uint8] * 4) for x in pdf["blob"]]
        token, times = np.concatenate([p[0] for p in parts]), np.concatenate([sum(p[1 + k].astype(np.int64) << 8 * k for k in range(4)) for p in parts])
        order = np.argsort(token, kind="stable")
        token, times = token[order], times[order]
        start, _ = _runs(token)
        total = np.add.reduceat(times, start)
        keep = np.flatnonzero(total >= LEAST_DF)
        if len(keep) > most:
            keep = np.sort(keep[np.lexsort((token[start][keep], -total[keep]))[:most]])
        return pd.DataFrame({"block": [key[0]], "token": [token[start][keep].tobytes()], "df": [np.minimum(total[keep], 2**32 - 1).astype(np.uint32).tobytes()]})

    return f


def frequent_tokens(texts: DataFrame, blocks: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(keys sorted, document counts) of the most frequent shingles, counted over all sets; key = block << 32 | token."""
    counted = texts.mapInArrow(_count(width, blocks), "block long, blob binary").groupBy("block").applyInPandas(_tally(max(1, FREQUENT // blocks)), "block long, token binary, df binary")
    keys, dfs = [], []
    for block, token, df in sorted(tuple(r) for r in counted.collect()):
        keys.append(np.uint64(block) << np.uint64(32) | np.frombuffer(token, np.uint32).astype(np.uint64))
        dfs.append(np.frombuffer(df, np.uint32))
    return (np.concatenate(keys), np.concatenate(dfs)) if keys else (np.empty(0, np.uint64), np.empty(0, np.uint32))


def keys_of(tokens: np.ndarray, blocks: int) -> np.ndarray:
    span = (1 << 64) // blocks + 1
    return (tokens // np.uint64(span)) << np.uint64(32) | (tokens % np.uint64(span)) >> np.uint64(max(0, span.bit_length() - 32))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(width: int, percent: int, blocks: int, frequent):
    def run(it):
        known, dfs = frequent.value
        rank = np.floor(np.log2(np.maximum(dfs, 1))).astype(np.int64)
        tokens, sids, rems, hots, n = [], [], [], [], 0

        def flush():
            t, s, r, hot = np.concatenate(tokens), np.concatenate(sids), np.concatenate(rems), np.concatenate(hots)
            for mine, salted in ((~hot, False), (hot, True)):
                order = np.argsort(t[mine], kind="stable")
                for block, blob in _packed(blocks, t[mine][order], s[mine][order], r[mine][order]):
                    salt = 1 + xxhash.xxh3_64_intdigest(blob) % (4 * blocks)
                    yield (-(salt * blocks + block) if salted else block), blob

        for s, sid in _distinct_sets(it, width):
            p = prefix_length(len(s), percent)
            if len(known):
                key = keys_of(s, blocks)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                there = known[at] == key
                first = np.argsort(np.where(there, rank[at], 0), kind="stable")[:p]
                hot = there[first] & (dfs[at[first]] >= HOT)
            else:
                first, hot = np.arange(p), np.zeros(p, bool)
            tokens.append(s[first])
            hots.append(hot)
            sids.append(np.full(p, short(sid), np.int64))
            # what is left of the set from this position on, of 200ths of the set, rounded up
            rems.append(np.minimum(255, -(-200 * (len(s) - np.arange(p)) // len(s))).astype(np.uint8))
            n += p
            if n >= BLOCK // 2:
                yield from _emit(flush())
                tokens, sids, rems, hots, n = [], [], [], [], 0
        if n:
            yield from _emit(flush())
        tokens, sids, rems, hots = [], [], [], []
        trim()

    return run


_MET = "token long, short long, rem int"


def _meet(blocks: int):
    """Of a block of postings, those whose token two different sets have; salted blocks pass through."""

    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpacked(x, np.int64, np.uint8) for x in pdf["blob"]]
        token, sid, rem = (np.concatenate([p[k] for p in parts]) for k in range(3))
        block = key[0] if key[0] >= 0 else -key[0] % blocks
        if key[0] >= 0:
            order = np.lexsort((sid, token))
            token, sid, rem = token[order], sid[order], rem[order]
            new = np.append(True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1]))
            token, sid, rem = token[new], sid[new], rem[new]
            start, size = _runs(token)
            keep = np.repeat(size > 1, size)
            token, sid, rem = token[keep], sid[keep], rem[keep]
        return pd.DataFrame({"token": (np.int64(block) << np.int64(32)) | token.astype(np.int64), "short": sid, "rem": rem.astype(np.int32)})

    return f


def _tokens(width: int, half: bool):
    """The tokens (or their upper halves) of the sets that are wanted, from the texts of their documents: once a task for each group."""
    schema = pa.schema([("gid", pa.binary()), ("chunk", pa.int64()), ("asks", pa.bool_()), ("sid", pa.binary()), ("tokens", pa.binary())])

    def run(it):
        seen = set()
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                text, out = b.column(0), {n: [] for n in schema.names}
                # the rows of one document stand together: its tokens are made once
                other = [True, *pc.not_equal(text.slice(1), text.slice(0, b.num_rows - 1)).fill_null(True).to_pylist()] if b.num_rows else []
                sets = shingle_sets(text.take(pa.array([k for k, x in enumerate(other) if x], pa.int64())), width)
                made, own = b"", b""
                for k, row in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 5)))):
                    if other[k]:
                        made = next(sets)
                        own, made = digest(made), (_half(made) if half else made).tobytes()
                    # texts of one id and text hash could differ, so that only the set itself tells
                    if own == row[3] and row not in seen:
                        seen.add(row)
                        for n, v in zip(schema.names, (*row, made)):
                            out[n].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=schema)
        trim()

    return run


def sent(df: DataFrame, most: int | None = None) -> DataFrame:
    """`df` written to the checkpoint folder, and marked for broadcast where its counted rows are few."""
    df = durable(df)
    return F.broadcast(df) if df.limit((most or BROADCAST_ROWS) + 1).count() <= (most or BROADCAST_ROWS) else df


def with_tokens(docs: DataFrame, known: DataFrame, wanted: DataFrame, width: int, half: bool = False) -> DataFrame:
    """wanted (gid, chunk, asks, sid) with tokens: sorted 64-bit hashes, or their upper halves, made from the texts."""
    rep = known.select("sid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.tkey").alias("rep_key"))
    met = sent(wanted.join(rep, "sid").select("rep_id", "rep_key", "gid", "chunk", "asks", "sid"), BROADCAST_SETS)
    texts = docs.join(met, F.col("doc_id").eqNullSafe(F.col("rep_id")) & F.col("tkey").eqNullSafe(F.col("rep_key"))).select("text", "gid", "chunk", "asks", "sid")
    return texts.mapInArrow(_tokens(width, half), "gid binary, chunk long, asks boolean, sid binary, tokens binary")


def _sets_of(pdf: pd.DataFrame, kind=np.uint64) -> dict[bytes, np.ndarray]:
    return {bytes(s): np.frombuffer(t, kind) for s, t in zip(pdf["sid"], pdf["tokens"])}


def _among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _half(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(32)).astype(np.uint32)


def _union(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's union, of tokens' upper halves: equal tokens have equal halves, so that its bounds hold."""
    sets = _sets_of(pdf, np.uint32)
    sizes = [len(s) for s in sets.values()]
    return pd.DataFrame({"gid": [key[0]], "least": [min(sizes)], "most": [max(sizes)], "tokens": [np.unique(np.concatenate(list(sets.values()))).tobytes()]})


def _bound(percent: int):
    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The groups that are to be opened for a query: those of whose members some could be similar to it."""
        found, queries = [], _sets_of(pdf[pdf["asks"]], np.uint32)
        unions = pdf[~pdf["asks"]]
        for gid, least, most, union in zip(unions["gid"], unions["least"], unions["most"], unions["tokens"]):
            union, least, most = np.frombuffer(union, np.uint32), int(least), int(most)
            for sid, t in queries.items():
                n = len(t)
                if 100 * most < percent * n or 100 * n < percent * least:
                    continue
                # of a member of m tokens min(x, m) are shared at most: similar if 100 * that >= percent * (n + m - that)
                x = int(_among(union, t).sum())
                m = max(least, min(x, most))
                x = min(x, m)
                if 100 * x >= percent * (n + m - x):
                    found.append((key[0], bytes(gid), sid, x / (n + m - x)))
        return pd.DataFrame(found, columns=["g", "gid", "sid", "bound"])

    return f


def _open(percent: int):
    def f(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The first link of each query with the group's members; they are connected already, so one will do."""
        found, sets = [], _sets_of(pdf[~pdf["asks"]])
        for q, t in _sets_of(pdf[pdf["asks"]]).items():
            for sid, s in sets.items():
                if sid != q and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                    x = int(_among(s, t).sum())
                    if 100 * x >= percent * (len(s) + len(t) - x):
                        found.append((q, sid))
                        break
        return pd.DataFrame(found, columns=["a", "b"])

    return f


def chunked(queries: DataFrame, key: str = "gid") -> tuple[DataFrame, DataFrame]:
    """queries (key, sid, n) with the chunk of their group that they go to; and key, chunks of every group."""
    per = queries.groupBy(key).agg(F.count(F.lit(1)).alias("q"), F.sum("n").alias("words"))
    per = sent(per.select(key, F.ceil(F.greatest(F.col("q") / QUERIES, F.col("words") / TOKENS)).alias("chunks")))
    return queries.join(per, key).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks"))).drop("chunks"), per


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))


def compare(docs: DataFrame, known: DataFrame, members: DataFrame, queries: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a-b of queries (gid, sid, n) with members (gid, sid) of their groups, one for each query and group."""
    asked, per = chunked(queries)
    shown = members.join(per, "gid").select("gid", "sid", _every("chunks").alias("chunk"), F.lit(False).alias("asks"))
    rows = with_tokens(docs, known, asked.select("gid", "sid", "chunk", F.lit(True).alias("asks")).unionByName(shown), width)
    return durable(rows.groupBy("gid", "chunk").applyInPandas(_open(percent), "a binary, b binary"))


def groups(known: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """g, parts: the number of groups of each of `clusters` (cluster); and g, part, gid, sid of their members."""
    size = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"))
    parts = sent(size.join(sent(clusters), "cluster", "left_semi").select(F.col("cluster").alias("g"), F.ceil(F.greatest(F.col("size") / GROUP, F.col("words") / TOKENS)).alias("parts")))
    members = known.join(parts, F.col("cluster") == F.col("g")).withColumn("part", F.pmod(F.xxhash64("sid", F.lit(3)), F.col("parts")))
    return parts, durable(members.select("g", "part", _gid(F.col("part")), "sid"))


def _gid(part: Column) -> Column:
    return F.concat(F.col("g"), F.concat(F.lit("/"), part.cast("string")).cast("binary")).alias("gid")


def matrix(docs: DataFrame, known: DataFrame, sided: DataFrame, width: int, percent: int) -> DataFrame:
    """known with clusters q and g of `sided` merged where they are linked: q's members are bounded against g's unions."""
    parts, members = groups(known, sided.select(F.col("g").alias("cluster")).distinct())
    whole = with_tokens(docs, known, members.select("gid", F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("asks"), "sid"), width, True)
    unions = durable(whole.groupBy("gid").applyInPandas(_union, "gid binary, least long, most long, tokens binary"))
    release(docs.sparkSession)
    # a task holds some queries of all that ask a cluster, and some unions (a lot) of that cluster
    lots = parts.select("g", F.ceil(F.col("parts") / UNIONS).alias("lots"))
    asked = known.select("sid", "n", F.col("cluster").alias("q")).join(sent(sided), "q").select("g", "sid", "n")
    asked, per = chunked(durable(asked), "g")
    lot = lambda c: F.concat(F.col("g"), F.lit("/").cast("binary"), c.cast("string").cast("binary"))
    queries = asked.join(lots, "g").withColumn("lot", _every("lots")).select(lot(F.col("lot")).alias("gid"), "chunk", F.lit(True).alias("asks"), "sid")
    nothing = {"least": F.lit(None).cast("long"), "most": F.lit(None).cast("long"), "of": F.lit(None).cast("binary")}
    queries = with_tokens(docs, known, queries, width, True).withColumns(nothing)
    of = members.select("g", "part", "gid").distinct().join(lots, "g").join(per, "g")
    shown = unions.join(of, "gid").withColumn("chunk", _every("chunks")).select(lot(F.pmod("part", "lots")).alias("gid"), "chunk", F.lit(False).alias("asks"), F.lit(None).cast("binary").alias("sid"), "tokens", "least", "most", F.col("gid").alias("of"))
    rows = queries.unionByName(shown).withColumnsRenamed({"gid": "lot", "of": "gid"})
    opened = rows.groupBy("lot", "chunk").applyInPandas(_bound(percent), "g binary, gid binary, sid binary, bound double")
    opened = opened.drop("g").join(members.select("gid", "g").distinct(), "gid").join(known.select("sid", "n", F.col("cluster").alias("q")), "sid")
    opened = durable(opened.select("q", "g", "gid", "sid", "n", "bound"))
    release(docs.sparkSession)
    best = opened.groupBy("q", "g").agg(F.max(F.struct("bound", "gid", "sid", "n")).alias("b")).select("b.gid", "b.sid", "b.n")
    members = members.select("gid", "sid")
    for rest in (best, None):
        if rest is None:  # a cluster's name is one of its sets
            now = known.select("sid", "cluster")
            rest = opened.join(now.toDF("sid", "q2"), "sid").join(now.toDF("g", "g2"), "g").where("q2 <> g2").select("gid", "sid", "n")
        rest = durable(rest)
        if not rest.isEmpty():
            known = merge(known, compare(docs, known, members.join(sent(rest.select("gid").distinct()), "gid", "left_semi"), rest, width, percent))
            release(docs.sparkSession)
    return known


def merge(known: DataFrame, links: DataFrame) -> DataFrame:
    """known with clusters joined by links (a, b) between their sets."""
    of = known.select("sid", "cluster")
    edges = links.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    labels = sent(components(edges).toDF("cluster", "label"))
    return durable(known.join(labels, "cluster", "left").select("sid", "n", "rep", F.coalesce("label", "cluster").alias("cluster")))


def _clusters(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """known: sid, n, rep, cluster of every set, clusters being connected sets."""
    known = durable(classes.select("sid", "n", "rep", F.col("sid").alias("cluster")))
    banded = classes.select("sid", F.posexplode("bands").alias("band", "h"))
    shared = banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    banded = durable(banded.join(sent(shared), ["band", "h"]))
    for _ in range(ROUNDS):
        size = sent(known.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        mine = banded.join(known.select("sid", "cluster"), "sid").join(size, "cluster", "left").withColumn("size", F.coalesce("size", F.lit(1)))
        first = F.struct("size", "cluster")
        leads = mine.groupBy("band", "h").agg(F.max(first).alias("lead"), F.min(first).alias("last")).where("lead <> last").select("band", "h", "lead")
        led = mine.join(sent(leads), ["band", "h"]).where("cluster <> lead.cluster").groupBy("sid", "lead").agg(F.count(F.lit(1)).alias("k"))
        asked = durable(led.groupBy("sid").agg(F.max(F.struct("lead.size", "k", "lead.cluster"))["cluster"].alias("g")))
        if asked.isEmpty():
            break
        parts, members = groups(known, asked.select(F.col("g").alias("cluster")).distinct())
        queries = asked.join(parts, "g").join(known.select("sid", "n"), "sid").select(_gid(F.pmod(F.xxhash64("sid", F.lit(1)), F.col("parts"))), "sid", "n")
        links = compare(docs, known, members, durable(queries), width, percent)
        if links.isEmpty():
            break
        known = merge(known, links)
        release(docs.sparkSession)
    return known


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, tkey (hash of the text), n, sid of every row of `docs`; and sid, n, rep, component, k (rows) of every set."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    sets = durable(docs.mapInArrow(_sets(width), "doc_id long, tkey long, n long, sid binary, bands array<long>"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = min(FREQUENT, max(16, -(-total // BLOCK)))
    # a set is known by a row that isn't without an id, if there is one
    place = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")
    classes = durable(sets.where("n > 0").groupBy("sid", "n").agg(F.min(place).alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("k")))

    # 2. clusters
    known = _clusters(docs, classes, width, percent)
    release(spark)

    # 3. postings
    texts = docs.select("text")
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, blocks, width))
    release(spark)
    met = texts.mapInArrow(_postings(width, percent, blocks, frequent), "block long, blob binary").groupBy("block").applyInPandas(_meet(blocks), _MET)
    of = known.select("cluster", "n", F.conv(F.hex(F.substring("sid", 1, 8)), 16, -10).cast("long").alias("short"))
    rows = met.join(of, "short").groupBy("token", "cluster").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.ceil(F.col("rem") * F.col("n") / 200)).alias("rem"))
    rows = durable(rows)
    many = rows.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token", F.ceil(F.col("k") / HOT_CLUSTERS).alias("salts"))
    rows = durable(rows.join(many, "token"))
    release(spark)

    # 4. matrix
    a = rows.withColumn("salt", F.pmod(F.xxhash64("cluster"), F.col("salts"))).alias("a")
    b = rows.withColumn("salt", _every("salts")).alias("b")
    t = percent / 100
    fits = (
        (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.cluster") < F.col("b.cluster"))
        & (100 * F.col("a.most") >= percent * F.col("b.least")) & (100 * F.col("b.most") >= percent * F.col("a.least"))
        & (F.least("a.rem", "b.rem") >= F.floor((F.col("a.least") + F.col("b.least")) * (t / (1 + t)) - 1e-6))
    )
    pairs = durable(a.join(b, fits).select(F.col("a.cluster").alias("c"), F.col("b.cluster").alias("d")).distinct())
    counts = known.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    c, d = counts.select(F.col("cluster").alias("c"), F.col("k").alias("kc")), counts.select(F.col("cluster").alias("d"), F.col("k").alias("kd"))
    sided = pairs.join(c, "c").join(d, "d").select(F.when(F.col("kc") <= F.col("kd"), F.col("c")).otherwise(F.col("d")).alias("q"), F.when(F.col("kc") <= F.col("kd"), F.col("d")).otherwise(F.col("c")).alias("g"))
    sided = durable(sided)
    if not sided.isEmpty():
        known = matrix(docs, known, sided, width, percent)

    # 5. components of clusters
    return sets, known.withColumnRenamed("cluster", "component").join(classes.select("sid", "k"), "sid")


def _of_sets(sets: DataFrame, per_set: DataFrame, k: DataFrame) -> DataFrame:
    """Rows of `sets` with words and the columns of per_set (one row a sid); sets of many rows come by broadcast."""
    rows = sets.where("n > 0")
    hot = durable(per_set.join(k.where(F.col("k") > HOT_COPIES).select("sid"), "sid", "left_semi"))
    n_hot = hot.limit(BROADCAST_ROWS + 1).count()
    if not 0 < n_hot <= BROADCAST_ROWS:
        return rows.join(per_set, "sid")
    own = [c for c in per_set.columns if c != "sid"]
    first = rows.join(F.broadcast(hot.select(F.col("sid").alias("__hot"), F.struct(*own).alias("__h"))), F.col("sid") == F.col("__hot"), "left")
    # rows of hot sets are dealt by a key that no set has
    key = F.when(F.col("__hot").isNull(), F.col("sid")).otherwise(F.unhex(F.md5(F.concat_ws(" ", F.lit("hot"), "doc_id", "tkey"))))
    rest = first.withColumn("__key", key).join(per_set.select(F.col("sid").alias("__key"), F.struct(*own).alias("__p")), "__key", "left")
    return rest.withColumn("__p", F.coalesce("__h", "__p")).select(*rows.columns, "__p.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Words are lower-cased A-Z; fewer words than `width` make one shingle. Documents link when
    100 * |intersection| >= percent * |union|; component_id is the least doc_id reachable by links. Documents
    without words (null, empty) link with nothing and keep their own id. Repeated rows and copies share a
    component. Rows with a null id take part; their component has the least id that isn't null, if any.
    Empty table: empty result. Other columns are ignored.
    """
    sets, final = _linked(docs, id_col, text_col, width, percent)
    # clusters of one set need no join by component, which a large cluster would make uneven
    least = sent(final.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.min("rep.doc_id").alias("component_id")).where("m > 1").drop("m"))
    per_set = durable(final.join(least, "component", "left").select("sid", F.coalesce("component_id", "rep.doc_id").alias("component_id")))
    linked = _of_sets(sets, per_set, final).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the least id, columns unchanged.

    A document is an id and a text: other texts of the same id stay or go by themselves. Ids that are null come last;
    of equal ids the least set stays. Repeated rows of a document that stays all stay, but rows with words
    and no id are documents of their own, of which one stays. Documents without words always stay.
    """
    sets, final = _linked(docs, id_col, text_col, width, percent)
    first = F.struct("rep.z", "rep.doc_id", "sid", "rep.tkey")
    firsts = sent(final.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.min(first).alias("first")).where("m > 1").drop("m"))
    per_set = durable(final.join(firsts, "component", "left").select("sid", F.coalesce("first", first).alias("first")))
    lost = _of_sets(sets, per_set, final).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))))
    gone = durable(lost.select(F.col("doc_id").alias("__gone"), F.col("tkey").alias("__key")).distinct())
    own, text = docs[id_col].cast("long"), docs[text_col].cast("string")
    left = docs.join(gone, own.eqNullSafe(F.col("__gone")) & (F.xxhash64(text) == F.col("__key")), "left_anti")
    nameless = F.col(id_col).cast("long").isNull() & F.coalesce(F.col(text_col).cast("string").rlike(WORD), F.lit(False))
    return left.where(~nameless).unionByName(left.where(nameless).dropDuplicates([text_col]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document's set; nulls, empties and repeats as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM x JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * x >= 75 * (na.n + nb.n - x)),
r AS (
  WITH RECURSIVE reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.doc_id)
  SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id)
"""
