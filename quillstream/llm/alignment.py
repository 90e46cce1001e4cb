"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their ids stand on the same bytes.

Both tokenizers read space + text. The ends of tokens are running sums of their byte lengths; ends that both share cut
the text into groups, found by intersect1d; searchsorted gives every token its group and every A token its first and last
overlapping B token; repeat expands those runs to links. That runs once over each distinct segment of a text (both
tokenizers always cut where a segment begins), and documents add up their segments.

Links are counted by documents: lots of documents count their own pairs, a salted first shuffle adds up shares of a
pair, a second one the shares. The counts come back to the lots by a join, never by a broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, stored, table, trim

#: Bytes of text in a lot, about; segments that a worker remembers; shares that a pair's rows are dealt to.
LOT, REMEMBERED, SALTS = 8_000_000, 600_000, 8
_WORKER: dict = {}
_SIGNS = ".,;:!?"
#: Fixed value: how byte-level vocabularies cut a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Blanks other than space and line end; a sign that ends a word after no letter.
_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SIGN = re.compile(rf"[{_SIGNS}](?<![A-Za-zÀ-ÖØ-öø-ɏ \n{_SIGNS}].)[{_SIGNS}]*(?![^ \n])")
_CUT = re.compile(r"(?<=\S)(?= \s*\S)")
_SEGMENT = re.compile(rf"\n| ?[^ \n{_SIGNS}]+(?:[{_SIGNS}]+[^ \n{_SIGNS}]+)*| ?[{_SIGNS}]+(?![^ \n])| ?[^ \n]+")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and what is known of the segments met so far: ids, links and how their groups are written."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, v)), np.int64) for v in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        # segments stand alone if A cuts by words and no piece of B goes on past a blank, holds a line end, or has a sign after a letter
        self.by_words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and kind["normalizer"] is None
        self.by_words &= not any("▁" in p.lstrip("▁") or "\n" in p or any(x.isalpha() and y in _SIGNS for x, y in zip(p, p[1:])) for p in pieces)
        self.by_words &= all(self._joined(self.bytes_b, self.b.encode(t)) == b" " + t.encode() for t in ("a  b", " a", "a ", "a\nb"))
        self.fast_a = self._ranks(kind) if self.by_words else None
        self.line_a, self.line_b = self.a.encode("\n", add_special_tokens=False).ids[0], self.b.encode("\n")[-1]
        self.clear()

    def _ranks(self, kind: dict):
        """A's vocabulary in the tiktoken library, several times as fast on new words: it merges by ids, so A's merges must be in the order of ids."""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in kind["model"]["merges"]]
        ids = [kind["model"]["vocab"].get(x + y, -1) for x, y in merges]
        if ids != sorted(set(ids)) or not ids or ids[0] < 256:
            return None
        import tiktoken

        ranks = {self.bytes_a[i]: i for i in kind["model"]["vocab"].values() if self.bytes_a[i] and i not in self.a.get_added_tokens_decoder()}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _joined(of: list[bytes], ids: list[int]) -> bytes:
        return b"".join([of[i] for i in ids])

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[bytes] = []  # how a segment's groups are written; b"" where its bytes differ
        self.sizes = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.first = np.zeros(1, np.int64)  # where a segment's links begin
        self.link_a, self.link_b = np.empty(0, np.int32), np.empty(0, np.int32)

    def segments(self, text: str) -> list[str]:
        """Space + text in pieces at whose ends both tokenizers always cut: words, line ends, signs that end a word."""
        if not self.by_words:
            return [" " + text]
        odd = text[0] in " \n" or text[-1] in " \n" or any(two in text for two in ("  ", " \n", "\n ", "\n\n")) or _BLANK.search(text) or _SIGN.search(text)
        return (_CUT.split if odd else _SEGMENT.findall)(" " + text)

    def _ids(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments. Those without a line end go to the libraries many at once, each after a line end."""
        out_a, out_b = [[]] * len(keys), [[]] * len(keys)
        plain = [k for k, s in enumerate(keys) if self.by_words and "\n" not in s]
        runs = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        texts = ["\n" + "\n".join([keys[k] for k in r]) for r in runs]
        found_a = map(self.fast_a.encode_ordinary, texts) if self.fast_a else (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))
        for out, line, found in ((out_a, self.line_a, found_a), (out_b, self.line_b, self.b.encode(texts, num_threads=1))):
            for r, ids in zip(runs, found):
                at = [k for k, i in enumerate(ids) if i == line]
                if len(at) != len(r):
                    raise ValueError("a tokenizer doesn't keep words apart at line ends")
                for k, x, y in zip(r, at, [*at[1:], len(ids)]):
                    out[k] = ids[x + 1 : y]
        rest = [k for k, s in enumerate(keys) if not self.by_words or "\n" in s]
        for k, e in zip(rest, self.a.encode_batch_fast([keys[k] for k in rest], add_special_tokens=False) if rest else ()):
            s = keys[k]
            out_a[k] = e.ids
            out_b[k] = self.b.encode(s[1:]) if s[0] == " " else [self.line_b]
        return out_a, out_b

    def learn(self, keys: list[str]) -> None:
        """Aligns new segments, all in one run of arrays. One whose bytes aren't given back has no tokens."""
        ids_a, ids_b = self._ids(keys)
        n, data = len(keys), [s.encode() for s in keys]
        for k, s in enumerate(data):
            if self._joined(self.bytes_a, ids_a[k]) != s or self._joined(self.bytes_b, ids_b[k]) != s:
                ids_a[k], ids_b[k], data[k] = [], [], b""
        na, nb, whole = (np.fromiter(map(len, v), np.int64, n) for v in (ids_a, ids_b, data))
        a, b = (np.fromiter(chain.from_iterable(v), np.int64, int(m.sum())) for v, m in ((ids_a, na), (ids_b, nb)))
        size_a, size_b = self.size_a[a], self.size_b[b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        groups = np.diff(np.searchsorted(cuts, np.cumsum(whole), side="right"), prepend=0)
        low, high = np.searchsorted(end_b, end_a - size_a, side="right"), np.searchsorted(end_b - size_b, end_a)
        wide = high - low
        step = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        link_a, link_b = np.repeat(a, wide).astype(np.int32), b[np.repeat(low, wide) + step].astype(np.int32)
        links = np.diff(np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(na))])
        # each group in text: its A ids, a bar, its B ids
        split_a, split_b = (np.append(np.searchsorted(g, np.arange(len(cuts))), len(g)).tolist() for g in (group_a, group_b))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        written = [f"{','.join(text_a[w:x])}|{','.join(text_b[y:z])}" for w, x, y, z in zip(split_a, split_a[1:], split_b, split_b[1:])]
        at = np.append(0, np.cumsum(groups)).tolist()
        self.known.update(zip(keys, range(len(self.texts), len(self.texts) + n)))
        self.texts += [";".join(written[x:y]).encode() for x, y in zip(at, at[1:])]
        self.sizes = np.concatenate([self.sizes, np.stack([na, nb, groups], 1)])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(links))
        self.link_a, self.link_b = np.append(self.link_a, link_a), np.append(self.link_b, link_b)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Segment numbers of each text. Learns what is new; forgets the rest before, where the two together are too many."""
        keys = [self.segments(t) if t else [] for t in texts]
        new = {k for ks in keys for k in ks}
        fresh = [k for k in new if k not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED and self.known:
            self.clear()
            fresh = list(new)
        for at in range(0, len(fresh), 20_000):
            self.learn(fresh[at : at + 20_000])
        return [np.fromiter(map(self.known.__getitem__, ks), np.int64, len(ks)) for ks in keys]


def pair(path_a: str | None, path_b: str | None) -> Pair:
    """This worker's tokenizers: loaded once, kept between tasks."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    if (path_a, path_b) not in _WORKER:
        _WORKER.clear()
        _WORKER[path_a, path_b] = Pair(path_a, path_b)
    return _WORKER[path_a, path_b]


#: kind 0: a document (at: its place in the lot); 1: a pair of ids (at: its number in the lot, n: documents); 2: the lot's links, packed.
_LOTS = pa.schema([("lot", pa.int64()), ("kind", pa.int8()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("digest", pa.string()), ("groups", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("links", pa.binary())])
_LOTS_DDL = "lot long, kind byte, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, groups string, a int, b int, n long, links binary"


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _LOTS], schema=_LOTS)


def _lot(number: int, p: Pair, ids: list, texts: list[str | None], written: bool) -> Iterator[pa.RecordBatch]:
    numbers = p.numbers(texts)
    size = np.fromiter(map(len, numbers), np.int64, len(texts))
    seg = np.concatenate(numbers) if len(numbers) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    bad = np.unique(doc[p.sizes[seg, 0] == 0])
    keep = ~np.isin(doc, bad)
    seg, doc = seg[keep], doc[keep]
    n = np.stack([np.bincount(doc, p.sizes[seg, k], len(texts)).astype(np.int64) for k in range(3)], 1)
    # distinct segments of a document, then distinct pairs of ids
    own, times = np.unique(doc * len(p.texts) + seg, return_counts=True)
    doc, seg = own // max(len(p.texts), 1), own % max(len(p.texts), 1)
    wide = p.first[seg + 1] - p.first[seg]
    at = np.repeat(p.first[seg] - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
    codes, code = np.unique(p.link_a[at].astype(np.int64) << 32 | p.link_b[at], return_inverse=True)
    key, times = np.repeat(doc, wide) * max(len(codes), 1) + code, np.repeat(times, wide)
    order = np.argsort(key)
    key, times = key[order], times[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.add.reduceat(times, new) if len(new) else times
    key = key[new]
    doc, code = key // max(len(codes), 1), key % max(len(codes), 1)
    digests, groups, bad = [], [], set(bad.tolist())
    for k, v in enumerate(numbers):
        text = b";".join([p.texts[i] for i in v.tolist()]) if len(v) and k not in bad else b""
        digests.append(hashlib.sha256(text).hexdigest() if text else "")
        groups.append(text.decode() if written else None)
    links = np.bincount(doc, times, len(texts)).astype(np.int64)
    yield _rows(lot=[number] * len(texts), kind=[0] * len(texts), at=np.arange(len(texts), dtype=np.int32), doc_id=ids, n_a=n[:, 0], n_b=n[:, 1], n_groups=n[:, 2], n_links=links, digest=digests, groups=groups)
    held = np.bincount(code, minlength=len(codes))
    for k in range(0, len(codes), 50_000):
        part = codes[k : k + 50_000]
        yield _rows(lot=np.full(len(part), number), kind=np.ones(len(part), np.int8), at=np.arange(k, k + len(part), dtype=np.int32), a=(part >> 32).astype(np.int32), b=(part & 0xFFFFFFFF).astype(np.int32), n=held[k : k + len(part)])
    yield _rows(lot=[number], kind=[2], at=[0], links=[pack_links(doc, code, times, len(texts))])


def pack_links(doc: np.ndarray, code: np.ndarray, times: np.ndarray, docs: int) -> bytes:
    """Sorted (document, pair, occurrences), as deflated byte planes of steps between pairs."""
    count = np.bincount(doc, minlength=docs)
    step = np.diff(code, prepend=0)
    first = np.cumsum(count) - count
    step[first[count > 0]] = code[first[count > 0]]
    planes = np.concatenate([np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel() for v in (count, step, times)])
    return np.array([docs, len(code)], "<u8").tobytes() + zlib.compress(planes.tobytes(), 1)


def unpack_links(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, n = np.frombuffer(data[:16], "<u8").astype(int)
    planes = np.frombuffer(zlib.decompress(data[16:]), np.uint8)
    out, at = [], 0
    for m in (docs, n, n):
        out.append(np.ascontiguousarray(planes[at : at + 4 * m].reshape(4, m).T).view("<u4").ravel().astype(np.int64))
        at += 4 * m
    count, step, times = out
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    before = np.append(0, total)[first]
    return np.repeat(np.arange(docs), count), total - np.repeat(before, count), times


def _mapper(path_a: str | None, path_b: str | None, written: bool):
    def run(it):
        p, k, base = pair(path_a, path_b), 0, TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for whole in it:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids.append(i)
                    texts.append(t)
                    size += len(t or "")
                    if size >= LOT:
                        yield from _lot(base + k, p, ids, texts, written)
                        ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield from _lot(base + k, p, ids, texts, written)
        p.clear()
        trim()

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])
_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """One lot: its documents with what the corpus says of their links."""
    kind = np.asarray(docs["kind"])
    rows = docs.take(np.flatnonzero(kind == 0))
    rows = rows.take(np.argsort(np.asarray(rows["at"]), kind="stable"))
    doc, code, times = unpack_links(docs["links"][int(np.flatnonzero(kind == 2)[0])].as_py())
    n, best = np.zeros(pairs.num_rows, np.int64), np.zeros(pairs.num_rows, np.int64)
    at = np.asarray(pairs["number"])
    n[at], best[at] = np.asarray(pairs["n"]), np.asarray(pairs["best"])
    total, top = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
    np.add.at(total, doc, n[code] * times)
    np.add.at(top, doc, best[code] * times)
    own = {"n_best": pa.array(top), "count_sum": pa.array(total), "groups_sha256": rows["digest"]}
    return pa.table([own[f.name] if f.name in own else rows[f.name] for f in _OUT], schema=_OUT)


def aligned_lots(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, written: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lots of documents with their own pair counts and packed links, as a table in the shared folder."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(thin.mapInArrow(_mapper(path_a, path_b, written), _LOTS_DDL))


def pair_counts(lots: DataFrame) -> DataFrame:
    """a, b, n: how many documents hold A id a linked with B id b. A pair's rows are dealt to SALTS shares first."""
    salted = lots.where("kind = 1").select("a", "b", F.pmod(F.xxhash64("lot"), F.lit(SALTS)).alias("salt"), "n")
    return salted.groupBy("a", "b", "salt").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, written: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups for every row of `docs`.

    groups is the text behind the digest if `written`, else null. Null and empty texts, and texts whose bytes one of the
    tokenizers doesn't give back (U+2581 in a text), have zeros and an empty digest. Rows without an id and repeated rows
    are documents of their own and count as such. Empty table: empty result. Other columns are ignored.
    """
    lots = aligned_lots(docs, path_a, path_b, written, id_col, text_col)
    counts = stored(pair_counts(lots))
    best = counts.groupBy("a").agg(F.max("n").alias("most")).withColumnRenamed("a", "a_")
    judged = counts.join(best, F.col("a") == F.col("a_")).select(F.col("a").alias("pa"), F.col("b").alias("pb"), "n", (F.col("n") == F.col("most")).cast("int").alias("best"))
    mine = lots.where("kind = 1").select(F.col("lot").alias("of"), F.col("at").alias("number"), "a", "b").join(judged, (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb"))).select("of", "number", "n", "best")
    rows = lots.where("kind <> 1").select("lot", "kind", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "links")
    return rows.groupBy("lot").cogroup(mine.groupBy("of")).applyInArrow(_sums, _OUT_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document; nulls, empties and repeats as in align."""
    return align(table(spark, sf_dir, "documents")).drop("groups")
