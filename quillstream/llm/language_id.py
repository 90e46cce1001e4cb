"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation
through time, labels every byte position; a document's probabilities are the mean over its positions.

The network runs over the bytes of whole texts, blanks included. A text longer than a window is cut into windows that
overlap by LAP bytes on either side: both directions warm up on what lies around the bytes that the window labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table

HIDDEN = 8
#: Bytes that a window labels, and bytes before and after them that only warm it up; windows that run in step.
CORE, LAP, LANES = 224, 16, 1024
#: What the classifier is fitted on: at most so many labelled documents of a language, FITTED in all, one stretch of at
#: most STRETCH characters of each.
SAMPLE, FITTED, STRETCH = 300, 20_000, 4_000
#: Training: steps of BATCH stretches of TRAIN bytes.
STEPS, BATCH, RATE, TRAIN = 300, 256, 0.02, 48
UNKNOWN = "und"


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Model:
    """langs; per direction input rows (256, 3H), recurrent weights (H, 3H), output (H, K); output bias."""

    langs: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    v: list[np.ndarray]
    c: np.ndarray

    def run(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Label probabilities (T, B, K) of byte strings of one length, x being (T, B); and what training needs."""
        logits, kept = self.c, []
        for d in range(2):
            seq = x if d == 0 else x[::-1]
            h = np.zeros((x.shape[1], HIDDEN), np.float32)
            states, gates = [h], []
            for t in range(len(seq)):
                i, r = self.w[d][seq[t]], h @ self.u[d]
                zr = _sigmoid(i[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, g = zr[:, :HIDDEN], zr[:, HIDDEN:]
                n = np.tanh(i[:, 2 * HIDDEN :] + g * r[:, 2 * HIDDEN :])
                h = n + z * (h - n)
                states.append(h)
                gates.append((z, g, n, r[:, 2 * HIDDEN :]))
            hs = np.stack(states[1:])
            logits = logits + (hs if d == 0 else hs[::-1]) @ self.v[d]
            kept.append((seq, states, gates, hs))
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True), kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions; y: (B,) labels. In the order of params()."""
        p, kept = self.run(x)
        d_out = p.copy()
        d_out[:, np.arange(len(y)), y] -= 1
        d_out /= x.size
        gw, gu, gv = [], [], []
        for d in range(2):
            seq, states, gates, hs = kept[d]
            out = d_out if d == 0 else d_out[::-1]
            gv.append(np.einsum("tbh,tbk->hk", hs, out))
            dw, du = np.zeros_like(self.w[d]), np.zeros_like(self.u[d])
            dh = np.zeros_like(states[0])
            for t in range(len(seq) - 1, -1, -1):
                dh = dh + out[t] @ self.v[d].T
                z, g, n, rn = gates[t]
                before = states[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dg = dn * rn * g * (1 - g)
                di = np.concatenate([dz, dg, dn], 1)
                dr = np.concatenate([dz, dg, dn * g], 1)
                np.add.at(dw, seq[t], di)
                du += before.T @ dr
                dh = dh * z + dr @ self.u[d].T
            gw.append(dw)
            gu.append(du)
        return [*gw, *gu, *gv, d_out.sum((0, 1))]

    def params(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.v, self.c]


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 3) -> Model | None:
    """Fits (text, language) samples with Adam; languages weigh alike, and within one every byte does. None without samples.

    A step's stretches have one length: TRAIN bytes of a language's texts joined by line ends, fewer where every language's are shorter.
    """
    langs = sorted({lang for _, lang in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    f = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0] if shape[0] != 256 else 4)).astype(np.float32)
    model = Model(langs, [f(256, 3 * HIDDEN) for _ in range(2)], [f(HIDDEN, 3 * HIDDEN) for _ in range(2)], [f(HIDDEN, len(langs)) for _ in range(2)], np.zeros(len(langs), np.float32))
    joined = [np.frombuffer("\n".join(t for t, of in samples if of == lang).encode("utf-8", "surrogatepass") + b"\n", np.uint8) for lang in langs]
    joined = [np.tile(x, -(-TRAIN // len(x))) if len(x) < TRAIN else x for x in joined]
    params = model.params()
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(langs), size=BATCH)
        n = TRAIN if step % 4 else 12  # short stretches, as short texts are
        x = np.stack([joined[k][a : a + n] for k in y for a in (rng.integers(len(joined[k]) - n + 1),)], 1)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, model.gradients(x, y), m, v):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


class Predictor:
    """Pooled label probabilities of documents; windows of many documents run in step, features by lanes."""

    def __init__(self, model: Model):
        h = HIDDEN
        self.langs = model.langs
        half = np.ones(3 * h, np.float32)
        half[: 2 * h] = 0.5  # a sigmoid is a tanh of half its argument
        self.w = [np.ascontiguousarray((w * half).T) for w in model.w]
        self.u = [np.ascontiguousarray((u * half).T) for u in model.u]
        self.v, self.c = [np.ascontiguousarray(v.T) for v in model.v], model.c[:, None].astype(np.float32)

    def _states(self, d: int, x: np.ndarray, active: np.ndarray, out: np.ndarray) -> None:
        """Adds direction d's part of the logits to out (T, K, lanes); x (T, lanes), lanes longest first, active (T,)."""
        h = np.zeros((HIDDEN, x.shape[1]), np.float32)
        w, u, v, k = self.w[d], self.u[d], self.v[d], 2 * HIDDEN
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            n = int(active[t])
            own = h[:, :n]
            i, r = np.take(w, x[t, :n], axis=1), u @ own
            gates = np.tanh(i[:k] + r[:k])
            gates += 1
            gates *= 0.5
            new = np.tanh(i[k:] + gates[HIDDEN:] * r[k:])
            own -= new
            own *= gates[:HIDDEN]
            own += new
            out[t, :, :n] += v @ own

    def windows(self, raw: list[bytes]) -> np.ndarray:
        """Label probabilities summed over the positions of each byte string, (documents, languages)."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        parts = -(-size // CORE)
        doc = np.repeat(np.arange(len(raw)), parts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        base = (np.cumsum(size) - size)[doc]
        core = nth * CORE
        a, z = np.maximum(core - LAP, 0), np.minimum(core + CORE + LAP, size[doc])
        low, high = core - a, np.minimum(core + CORE, size[doc]) - a  # labelled positions of a window
        sums = np.zeros((len(raw), len(self.langs)))
        order = np.argsort(a - z, kind="stable")
        for at in range(0, len(order), LANES):
            k = order[at : at + LANES]
            n = (z - a)[k]
            t = np.arange(int(n[0]))[:, None]
            x = data[np.minimum((base + a)[k] + t, len(data) - 1)]
            active = len(n) - np.searchsorted(n[::-1], t[:, 0], side="right")
            logits = np.zeros((len(t), len(self.langs), len(k)), np.float32)
            logits += self.c
            for d in range(2):
                self._states(d, x, active, logits)
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits, out=logits)
            p *= (((t >= low[k]) & (t < high[k])) / p.sum(1))[:, None]
            np.add.at(sums, doc[k], p.sum(0, dtype=np.float64).T)
        return sums

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        import regex

        letter, out = regex.compile(r"\p{L}").search, [(UNKNOWN, 0.0)] * len(texts)
        lot, held = [], 0
        for k, t in enumerate(texts):
            if t and letter(t):
                lot.append(k)
                held += len(t)
            if lot and (held >= LANES * CORE or k + 1 == len(texts)):
                for i, total in zip(lot, self.windows([texts[i].encode("utf-8", "surrogatepass") for i in lot])):
                    best = int(total.argmax())
                    out[i] = (self.langs[best], float(min(1.0, total[best] / total.sum())))
                lot, held = [], 0
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(model: Model | None):
    def run(it):
        own = Predictor(model) if model else None

        def f(cols):
            texts = cols["text"].to_pylist()
            got = own.documents(texts) if own else [(UNKNOWN, 0.0)] * len(texts)
            return {"doc_id": cols["doc_id"], "lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

        yield from batches(it, _OUT, f)

    return run


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the label's mean probability) for every row; `und` and 0 for null texts, texts
    without a letter, and where nothing could be learned. Only the text is looked at."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null ids are fold -1."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(4)), F.lit(-1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> Model | None:
    """Learns from at most `sample` documents of each language outside fold 2 (FITTED of all languages together), those
    of least hash of id and text, and of a long one from a stretch of STRETCH characters at a place drawn by that hash.

    Rows without language, text or letter are not learned from; repeated rows count once. Counts by language cover all
    rows; a cut by hash brings about twice the sample to the driver, whatever a language's share.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where((fold(id_col) != 2) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("k")).collect()
    if not counts:
        return None
    sample = max(1, min(sample, FITTED // len(counts)))
    span = 1 << 30
    cut = docs.sparkSession.createDataFrame([(r[0], min(span, int(span * 2 * sample / r[1]) + 1)) for r in counts], "l string, most long")
    h = F.pmod(F.xxhash64("i", "t"), F.lit(span))
    hashed = rows.withColumn("h", h).join(F.broadcast(cut), "l").where("h < most")
    place = F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length("t") - STRETCH + 1)).cast("int") + 1
    thin = hashed.select("l", "h", F.substr("t", place, F.lit(STRETCH)).alias("t")).groupBy("l", "h").agg(F.min("t").alias("t"))
    by: dict[str, list] = {}
    for r in sorted(map(tuple, thin.collect())):
        if len(by.setdefault(r[0], [])) < sample:
            by[r[0]].append((r[2], r[0]))
    return train([x for xs in by.values() for x in xs], steps)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`, by a model learned outside the held-out fold.

    Null ids are never held out. Repeated rows are judged alike. An empty table gives an empty result, and a
    table without labels `und` everywhere. Other columns are ignored.
    """
    out = predict(docs, fit(docs, id_col, text_col, lang_col, sample, steps), id_col, text_col)
    return out.select("doc_id", (fold("doc_id") == 2).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; nulls, empties and repeats as in identify."""
    return identify(table(spark, sf_dir, "documents"))
