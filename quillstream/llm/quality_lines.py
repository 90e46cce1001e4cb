"""Quality rules by cross-document line frequency.

Normalised lines are hashed, distinct documents are counted per host for each line, lines above the limit
are removed, and documents depleted by that are rejected. Base rules on words and repeats come first.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, batches, durable, hashed_words, table, windows5

SYMBOLS = b"#*$%&|<>"
#: Over so many frequent lines the frequent-line table is joined by a shuffle instead of sent to the workers.
BROADCAST_LINES = 100_000


@dataclass(frozen=True)
class Limits:
    """A line is common when more than max(min_docs, share * documents of its host) distinct documents of the
    host have it; documents of equal texts are one. A document is depleted when common lines took more than max_removed of its words, or fewer
    than min_words are left."""

    min_docs: int = 20
    share: float = 0.05
    max_removed: float = 0.8
    min_words: int = 10
    max_repeat_percent: int = 20


def _norm_lines(text: str | None) -> list[tuple[str, bytes, int]]:
    """(line, 128-bit hash of its lower-cased words joined by blanks, number of words) of lines with a word."""
    out = []
    for line in (text or "").split("\n"):
        words = line.encode("utf-8", "surrogatepass").lower().split()
        if words:
            out.append((line, hashlib.md5(b" ".join(words)).digest(), len(words)))
    return out


_LINES = pa.schema([("host", pa.string()), ("line", pa.binary()), ("doc", pa.binary())])


def _line_rows(it):
    """A row per distinct line of each document, and one with a null line for the document itself.

    A document is known by the hash of its whole text, so that exact copies count as one document and don't make
    each other's lines common; any other difference makes documents distinct."""
    def f(cols):
        hosts, lines, docs = [], [], []
        for text, host in zip(cols["text"].to_pylist(), cols["host"].to_pylist()):
            own = {h for _, h, _ in _norm_lines(text)}
            if own:
                doc = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
                hosts += [host] * (len(own) + 1)
                docs += [doc] * (len(own) + 1)
                lines += [None, *own]
        return {"host": hosts, "line": lines, "doc": docs}

    yield from batches(it, _LINES, f)


def common_lines(docs: DataFrame, host_col: str, text_col: str, limits: Limits) -> DataFrame:
    """host, line (hash), n_docs of the lines above the limit."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host")).mapInArrow(_line_rows, "host string, line binary, doc binary")
    counts = rows.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = durable(counts.where((F.col("n_docs") > limits.min_docs) | F.col("line").isNull()))
    hosts = counts.where("line is null").select(F.col("host").alias("h"), F.col("n_docs").alias("of"))
    lines = counts.where("line is not null")
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n_docs") > F.greatest(F.lit(float(limits.min_docs)), F.lit(limits.share) * F.col("of"))).select("host", "line", "n_docs")


def n_repeat_words(words: np.ndarray) -> int:
    """Words in 5-word windows found twice or more in the text, the first time included; `words` are hashes."""
    n = len(words)
    if n < 6:
        return 0
    w = windows5(words)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(5):
        covered[k : k + len(w)] |= twice
    return int(covered.sum())


_STATS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_removed_words", pa.int64()), ("n_common_lines", pa.int64()), ("clean_text", pa.string())]
_STATS_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_words long, n_common_lines long, clean_text string"


def _stats_fn(frequent, with_text: bool, pass_cols: pa.Schema, hashes_out: bool):
    """frequent: a broadcast dict host -> set of line hashes, or None when a join does the removal."""
    schema = pa.schema([*pass_cols, *_STATS] + ([("lines", pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())])))] if hashes_out else []))

    def run(it):
        known = frequent.value if frequent is not None else {}

        def f(cols):
            out = {n: [] for n in schema.names}
            for n in pass_cols.names:
                out[n] = cols[n]
            words_of = (h[first[k] : first[k + 1]] for rows, h, first in hashed_words(cols["__text"], False) for k in range(rows))
            for text, host, words in zip(cols["__text"].to_pylist(), cols["__host"].to_pylist(), words_of):
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                lines, bad = _norm_lines(text), known.get(host, ())
                out["n_words"].append(len(words))
                out["word_chars"].append(len(text) - len(raw) + len(raw.translate(None, BLANKS)))
                out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
                out["n_dup_lines"].append(len(lines) - len({x for x, _, _ in lines}))
                out["n_repeat_words"].append(n_repeat_words(words))
                gone = [(h, n) for _, h, n in lines if h in bad]
                out["n_removed_words"].append(sum(n for _, n in gone))
                out["n_common_lines"].append(len(gone))
                if with_text and gone:
                    left = []
                    for line in text.split("\n"):
                        own = line.encode("utf-8", "surrogatepass").lower().split()
                        if not own or hashlib.md5(b" ".join(own)).digest() not in bad:
                            left.append(line)
                    out["clean_text"].append("\n".join(left))
                else:
                    out["clean_text"].append(text if with_text else None)
                if hashes_out:
                    out["lines"].append([{"line": h, "words": n} for _, h, n in lines])
            return out

        yield from batches(it, schema, f)

    return run


def quality_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", limits: Limits = Limits(), with_text: bool = False, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Every row and column of `docs`, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_words, n_common_lines, base_failed, kept and, with_text, clean_text (common lines removed).

    Null and empty texts have no words and fail the base rules. A null host is a host of its own. Repeated
    rows are judged alike and count as one document. Empty table: empty result. Columns of `docs` that have
    one of these names are replaced.

    Lines above the limit are few by their definition, but nothing bounds them: up to `broadcast_lines` of
    them are counted first and sent to the workers; beyond that, lines and documents meet in a join.
    """
    spark = docs.sparkSession
    common = durable(common_lines(docs, host_col, text_col, limits))
    few = common.limit(broadcast_lines + 1).count() <= broadcast_lines
    added = [n for n, _ in _STATS] + ["base_failed", "kept"]
    own = [c for c in docs.columns if c not in added]
    given = docs.select(*own, F.col(text_col).cast("string").alias("__text"), F.col(host_col).cast("string").alias("__host"))
    from pyspark.sql.pandas.types import to_arrow_schema

    pass_cols = to_arrow_schema(docs.select(*own).schema)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema), _STATS_DDL])
    if few:
        frequent: dict = {}
        for r in common.select("host", "line").collect():
            frequent.setdefault(r[0], set()).add(bytes(r[1]))
        out = given.mapInArrow(_stats_fn(spark.sparkContext.broadcast(frequent), with_text, pass_cols, False), ddl)
    else:
        out = _by_join(given, common, with_text, pass_cols, ddl, own)
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < limits.min_words) | (F.col("n_removed_words") > limits.max_removed * F.col("n_words")))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)
    return out if with_text else out.drop("clean_text")


def _by_join(given: DataFrame, common: DataFrame, with_text: bool, pass_cols, ddl: str, own: list[str]) -> DataFrame:
    """The same columns when the common lines are too many to send: per distinct text, lines join by hash."""
    stats = given.withColumn("__key", F.sha2(F.coalesce("__text", F.lit("")), 256)).mapInArrow(
        _stats_fn(None, False, pa.schema([*pass_cols, ("__text", pa.string()), ("__host", pa.string()), ("__key", pa.string())]), True),
        ddl.replace(_STATS_DDL, "__text string, __host string, __key string, " + _STATS_DDL + ", lines array<struct<line: binary, words: bigint>>"),
    )
    lines = stats.select("__host", "__key", F.explode("lines").alias("x")).groupBy("__host", "__key", "x.line").agg(F.max("x.words").alias("words"))
    per_doc = (
        lines.join(common, F.col("__host").eqNullSafe(F.col("host")) & (lines["line"] == common["line"]), "inner")
        .groupBy("__host", "__key")
        .agg(F.collect_set(lines["line"]).alias("__bad"))
        .select(F.col("__host").alias("__h"), F.col("__key").alias("__k"), "__bad")
    )
    both = stats.join(per_doc, F.col("__host").eqNullSafe(F.col("__h")) & (F.col("__key") == F.col("__k")), "left")
    gone = F.filter("lines", lambda x: F.array_contains(F.coalesce("__bad", F.array().cast("array<binary>")), x["line"]))
    norm = lambda s: F.unhex(F.md5(F.array_join(F.filter(F.split(F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")))
    clean = F.array_join(F.filter(F.split("__text", "\n", -1), lambda s: ~F.array_contains(F.coalesce("__bad", F.array().cast("array<binary>")), norm(s))), "\n")
    return both.withColumn("n_removed_words", F.aggregate(gone, F.lit(0).cast("long"), lambda a, x: a + x["words"])).withColumn("n_common_lines", F.size(gone).cast("long")).withColumn("clean_text", F.when(F.lit(with_text), F.coalesce(clean, F.lit("")))).select(*own, *[n for n, _ in _STATS])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document; nulls, empties and repeats as in quality_rules."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_common_lines")


def kept_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that stay, their columns unchanged but for text (common lines removed) and n_chars (its length
    where lines were removed), whatever their names. Rows with a null or empty text go; repeated rows stay or go together."""
    names = docs.columns
    own = {c: f"__own{k}" for k, c in enumerate(names)}
    out = quality_rules(docs.toDF(*own.values()), own["source"], own["text"], limits, True).where("kept")
    less = F.col("n_common_lines") > 0
    new = {"text": F.when(less, F.col("clean_text")).otherwise(F.col(own["text"]))}
    if "n_chars" in own:
        new["n_chars"] = F.when(less, F.length("clean_text").cast("long")).otherwise(F.col(own["n_chars"]))
    return out.select(*[new.get(c, F.col(own[c])).alias(c) for c in names])


_BLANK = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, source, doc, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, source, doc, unnest(string_split(text, chr(10))) AS line FROM d)
), n AS (SELECT doc_id, source, doc, line, len(lw) AS k, md5(array_to_string(lw, ' ')) AS h FROM l WHERE len(lw) > 0),
lc AS (SELECT source, h, count(DISTINCT doc) AS n_docs FROM n GROUP BY source, h),
hc AS (SELECT source, count(DISTINCT doc) AS n_of FROM n GROUP BY source),
bad AS (SELECT lc.source, h FROM lc JOIN hc ON lc.source IS NOT DISTINCT FROM hc.source WHERE n_docs > greatest(20.0, 0.05 * n_of)),
rem AS (SELECT doc_id, sum(k) AS n_removed_words, count(*) AS n_common_lines FROM n JOIN bad ON n.source IS NOT DISTINCT FROM bad.source AND n.h = bad.h GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM (SELECT win.doc_id, win.i, unnest(range(0, 5)) AS j FROM win JOIN (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1) t ON win.doc_id = t.doc_id AND win.g = t.g) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_words, 0)::BIGINT AS n_removed_words, coalesce(n_common_lines, 0) AS n_common_lines
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_removed_words > 0.8 * n_words)) AS kept
FROM s
"""
