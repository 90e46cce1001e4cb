"""Token ids of whole texts with a public tokenizer, and bounded-memory helpers for them."""

from __future__ import annotations

import json
import os
import string

import numpy as np

from .common import mix

END_ID = 2
#: Words whose ids a worker remembers, at most (about 40 bytes each); characters of the texts that are cut at once.
MOST_REMEMBERED, CHARS = 1_000_000, 1 << 18
_WORKER: dict = {}
#: Line tabulation: stands between the texts of one cut.
_BREAK = "\x0b"
#: From this character on a version of Unicode may know letters that another one doesn't.
_LATIN = "ɐ"
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r\f\v")] = True
_M1, _SPACED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Table:
    """64-bit keys to numbers 0, 1, ...: open addressing in two arrays, for many keys at once."""

    def __init__(self, slots: int):
        self.mask = np.uint64(slots - 1)
        self.keys, self.numbers, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys (none of them 0), -1 where a key isn't there."""
        slot = (keys & self.mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.numbers[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        slot, keys = slot[left], keys[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            there = self.keys[slot]
            hit = there == keys
            out[left[hit]] = self.numbers[slot[hit]]
            on = ~hit & (there != 0)
            left, slot, keys = left[on], slot[on], keys[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives distinct keys that aren't there the next numbers, in their order."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        slot = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = free & (self.keys[slot] == keys)
            self.numbers[slot[mine]] = numbers[mine]
            keys, numbers, slot = keys[~mine], numbers[~mine], (slot[~mine] + 1) & int(self.mask)


class Encoder:
    """text -> ids as little-endian unsigned 32-bit bytes, as the tokenizers library gives them for the whole text.

    The library's byte-level pre-tokenizer never joins what a blank separates: a word takes the single space before
    it, a run of blanks is cut before its last one. So the ids of a text are those of its words and runs of blanks;
    each is given to the library once and remembered by a 64-bit hash and its length. Texts with an added token or with
    blanks beyond ASCII, and all texts of other kinds of tokenizers, are given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind["pre_tokenizer"] or {}
        self._lib = Tokenizer.from_file(path)
        added = self._lib.get_added_tokens_decoder().values()
        self._added = [a.content for a in added]
        line = self._ids("\n")
        self._by_words = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and kind["normalizer"] is None and len(line) == 1
        self._newline = line[0]
        self._sign = np.full(256, -1, np.int64)  # ids of ASCII signs that have one
        for c in string.punctuation:
            if len(own := self._ids(c)) == 1:
                self._sign[ord(c)] = own[0]
        code = np.random.default_rng().integers(1, 1 << 63, 257, dtype=np.int64).astype(np.uint64)
        self._code, self._base = code[:256], int(code[256]) | 1
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self._lib.encode(text, add_special_tokens=False).ids

    def _powers(self, n: int) -> None:
        n = 1 << (n - 1).bit_length()
        self._power, self._inverse = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (self._base, pow(self._base, -1, 1 << 64)))

    def forget(self) -> None:
        """Frees what a task has remembered; workers outlive their tasks."""
        self._powers(1 << 16)
        self._clear()

    def _clear(self) -> None:
        self._known = _Table(1 << (2 * MOST_REMEMBERED - 1).bit_length())
        self._size = np.empty(0, np.int32)  # bytes of a word, by number; -1: not by words
        self._first = np.zeros(1, np.int64)  # where its ids begin
        self._pool = np.empty(0, np.uint32)

    def _learn(self, bare: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of words with at most a space in front: line ends keep them apart in one text."""
        ids, count = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        runs = ["\n".join(bare[k : k + 512]) for k in range(0, len(bare), 512)]
        for at in range(0, len(runs), 16):
            for e in self._lib.encode_batch_fast(runs[at : at + 16], add_special_tokens=False):
                own = np.array(e.ids, np.uint32)
                line = own == self._newline
                ids.append(own[~line])
                count.append(np.diff(np.flatnonzero(line), prepend=-1, append=len(own)) - 1)
        if sum(map(len, count)) != len(bare):
            raise ValueError("the tokenizer doesn't keep words apart at line ends")
        return np.concatenate(ids), np.concatenate(count)

    def _remember(self, data: bytes, start: np.ndarray, end: np.ndarray, spaced: np.ndarray, key: np.ndarray, key_of) -> None:
        """Learns the items start:end of `data`, whose keys are new and distinct."""
        b, n = np.frombuffer(data, np.uint8), len(start)
        words = [data[a:z].decode() for a, z in zip(start.tolist(), end.tolist())]
        blank = _BLANK[b[start]]
        odd = np.fromiter((not w.isascii() and w.split() != [w] for w in words), bool, n)
        # letters and one sign are two words to the library: head and sign
        signed = np.flatnonzero((self._sign[b[end - 1]] >= 0) & (end - start > 1))
        heads = signed[np.fromiter(((w := words[k][:-1]).isalpha() and (w.isascii() or max(w) < _LATIN) for k in signed.tolist()), bool, len(signed))]
        head_key = key_of(start[heads], end[heads] - 1, spaced[heads])
        there = self._known.find(head_key)
        plain = ~(blank | odd)
        plain[heads] = False
        at = np.flatnonzero(plain)
        lost = there < 0
        wanted, pick, back = np.unique(np.append(key[at], head_key[lost]), return_index=True, return_inverse=True)
        bare = [words[k] for k in at.tolist()] + [words[k][:-1] for k in heads[lost].tolist()]
        front = np.append(spaced[at], spaced[heads[lost]]).tolist()
        ids, count = self._learn([(" " if front[k] else "") + bare[k] for k in pick.tolist()]) if len(pick) else (np.empty(0, np.uint32), np.empty(0, np.int64))
        runs = np.flatnonzero(blank)
        whole = [self._ids(words[k]) for k in runs.tolist()]
        pool = np.concatenate([self._pool, ids, np.array([x for r in whole for x in r], np.uint32)])
        count = np.append(count, np.array([len(r) for r in whole], np.int64))
        first = len(self._pool) + np.append(0, np.cumsum(count))[:-1]
        # where each item's ids are, and those of the heads that weren't known, which are remembered as words of their own
        f, c, tail = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
        f[at], c[at] = first[back[: len(at)]], count[back[: len(at)]]
        f[runs], c[runs] = first[len(wanted) :], count[len(wanted) :]
        f[heads[lost]], c[heads[lost]] = first[back[len(at) :]], count[back[len(at) :]]
        f[heads[~lost]] = self._first[there[~lost]]
        c[heads[~lost]] = self._first[there[~lost] + 1] - f[heads[~lost]]
        tail[heads] = self._sign[b[end[heads] - 1]]
        own, k = np.unique(head_key[lost], return_index=True)
        new = ~np.isin(own, key)
        own, k = own[new], heads[lost][k[new]]
        size = np.where(odd, -1, end - start).astype(np.int32)
        f, c, tail = np.append(f, f[k]), np.append(c, c[k]), np.append(tail, np.full(len(k), -1))
        ends = np.cumsum(c + (tail >= 0))
        made = np.empty(ends[-1], np.uint32)
        made[ends[tail >= 0] - 1] = tail[tail >= 0]
        begin = ends - c - (tail >= 0)
        step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        made[np.repeat(begin, c) + step] = pool[np.repeat(f, c) + step]
        self._known.add(np.append(key, own))
        self._size = np.concatenate([self._size, size, (end[k] - 1 - start[k]).astype(np.int32)])
        self._first = np.append(self._first, self._first[-1] + ends)
        self._pool = np.append(self._pool, made)

    def _some(self, texts: list[str]) -> list[bytes | None]:
        """Ids of the texts, without added tokens or _BREAK; None for those that can't be cut into words."""
        data = (_BREAK + _BREAK.join(texts) + _BREAK).encode()
        b = np.frombuffer(data, np.uint8)
        ink = ~_BLANK[b]
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1  # a word begins, ends, begins, ...
        start, end = edge[::2], edge[1::2]
        breaks = np.flatnonzero(b == 11)
        # runs of blanks: from the end of a word (or a break) to the next word (or break)
        blank = ~ink
        blank[breaks] = False
        flips = np.flatnonzero(np.diff(blank.view(np.int8), prepend=0, append=0))
        run, stop = flips[::2], flips[1::2]
        last, to_end = b[stop - 1], b[stop] == 11
        cut = np.where(to_end, stop, stop - 1)
        some, line = cut > run, ~to_end & (last != 32)
        starts = np.concatenate([start, run[some], stop[line] - 1])
        ends = np.concatenate([end, cut[some], stop[line]])
        spaced = np.zeros(len(starts), bool)
        spaced[: len(start)] = b[start - 1] == 32
        if len(starts) > len(start):
            order = np.argsort(starts, kind="stable")
            starts, ends, spaced = starts[order], ends[order], spaced[order]
        if len(b) >= len(self._power):
            self._powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self._code[b] * self._power[: len(b)], out=sums[1:])

        def key_of(a, z, s):
            h = mix((sums[z] - sums[a]) * self._inverse[a] + (z - a).astype(np.uint64) * _M1 + s * _SPACED)
            return np.maximum(h, np.uint64(1))

        key = key_of(starts, ends, spaced)
        number = self._known.find(key)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            _, at = np.unique(key[missing], return_index=True)
            if self._known.n + 2 * len(at) > MOST_REMEMBERED:
                self._clear()
                missing = np.arange(len(key))
                _, at = np.unique(key, return_index=True)
                if 2 * len(at) > MOST_REMEMBERED:  # one very long text
                    return [None] * len(texts)
            new = missing[at]
            self._remember(data, starts[new], ends[new], spaced[new], key[new], key_of)
            number[missing] = self._known.find(key[missing])
        first = self._first[number]
        count = self._first[number + 1] - first
        before = np.append(0, np.cumsum(count))
        ids = self._pool[np.repeat(first - before[:-1], count) + np.arange(before[-1])].tobytes()
        of = np.searchsorted(starts, breaks)  # the first item of each text
        bad = np.flatnonzero(self._size[number] != ends - starts)
        odd = set((np.searchsorted(breaks, starts[bad]) - 1).tolist())
        at = (4 * before[of]).tolist()
        return [None if k in odd else ids[at[k] : at[k + 1]] for k in range(len(texts))]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null texts are empty."""
        out: list[bytes | None] = [None] * len(texts)
        lot, chars = [], 0
        for k, t in enumerate(texts):
            if not t:
                out[k] = b""
            elif self._by_words and _BREAK not in t and not any(a in t for a in self._added):
                lot.append(k)
                chars += len(t)
            if lot and (chars >= CHARS or k + 1 == len(texts)):
                for i, ids in zip(lot, self._some([texts[i] for i in lot])):
                    out[i] = ids
                lot, chars = [], 0
        whole = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(whole, self._lib.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False) if whole else ()):
            out[k] = np.array(e.ids, np.uint32).tobytes()
        return out


def encoder(path: str | None) -> Encoder:
    """This worker's encoder: loaded once, kept between tasks."""
    path = path or default_tokenizer()
    if path not in _WORKER:
        _WORKER.clear()
        _WORKER[path] = Encoder(path)
    return _WORKER[path]
