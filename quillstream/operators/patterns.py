"""Many patterns in many texts: an automaton over a bounded shard of the patterns, texts read where they are.

A task builds the shard's automaton once and reads each text through it once, whatever the number of patterns. Only texts with a
match leave it, with the list of what they contain; no text moves to find that out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

#: Characters of the patterns of one shard, about (an automaton has a node for each at most).
SHARD = 1_000_000
#: Rows that a worker turns into Python objects at once.
ROWS = 500
_WORKER: dict = {}


def automaton(patterns: list[str], key: str):
    """This worker's automaton of the patterns; the last one is kept between tasks."""
    if key not in _WORKER:
        import ahocorasick

        _WORKER.clear()
        a = ahocorasick.Automaton()
        for p in patterns:
            if p:
                a.add_word(p, p)
        a.make_automaton()
        _WORKER[key] = a
    return _WORKER[key]


def found_in(text: str | None, a, blank: bool, whole: bool) -> list[str]:
    """Distinct patterns that the text contains, sorted; `whole`: only between characters that are neither letters nor digits."""
    if text is None:
        return []
    out = {""} if blank else set()
    if len(a):
        for end, p in a.iter(text):
            if p not in out and (not whole or not (end + 1 < len(text) and text[end + 1].isalnum() or end >= len(p) and text[end - len(p)].isalnum())):
                out.add(p)
    return sorted(out)


def _match(sent, key: str, text_at: int, whole: bool, schema: pa.Schema):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        a, blank = automaton(patterns, key), "" in patterns
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                hits = [found_in(x, a, blank, whole) for x in part.column(text_at).to_pylist()]
                some = [k for k, h in enumerate(hits) if h]
                if some:
                    kept = part.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array([hits[k] for k in some], pa.list_(pa.string()))], schema=schema)

    return run


def match_patterns(texts: DataFrame, patterns: DataFrame, pattern_col: str, text_col: str, keep: list[str] | None = None, name: str = "pattern", whole: bool = False, shard: int = SHARD) -> DataFrame:
    """The `keep` columns of `texts` (all) and a pattern, for every pair of a text and a distinct pattern that it contains.

    Null texts and null patterns match nothing, an empty pattern matches every text. whole: a match must stand between
    characters that are neither letters nor digits. Patterns go to the tasks in shards of `shard` characters, one pass over the
    texts each; a longer pattern is a shard of its own. Rows of `texts` that are equal have their pairs each. No texts or patterns: empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from .shared import durable

    spark = texts.sparkSession
    keep = texts.columns if keep is None else list(keep)
    rows = texts.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__read"))
    known = durable(patterns.where(F.col(pattern_col).isNotNull()).select(F.col(pattern_col).cast("string").alias("__p")).distinct())
    size = known.agg(F.sum(F.greatest(F.char_length("__p"), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-size // shard))
    kind = StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]], StructField("__found", ArrayType(StringType()))])
    out = None
    for k in range(shards):
        lot = [r[0] for r in known.where(F.pmod(F.xxhash64("__p"), F.lit(shards)) == k).collect()]
        sent = spark.sparkContext.broadcast(lot)
        part = rows.mapInArrow(_match(sent, uuid.uuid4().hex, len(keep), whole, to_arrow_schema(kind)), kind)
        part = part.select(*[F.col(c) for c in keep], F.explode("__found").alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def mentions(texts: DataFrame, names: DataFrame, name_col: str, key_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """The `keep` columns and the key of every name that a text mentions: whole words, case ignored, once a text and key.

    A name is trimmed; a possessive ending doesn't hide it. Blank and null names are never mentioned.
    """
    low = names.select(F.col(key_col).alias("__key"), F.lower(F.trim(F.col(name_col))).alias("__name")).where("__name <> ''").distinct()
    read = texts.select(*keep, F.lower(F.col(text_col)).alias("__low"))
    met = match_patterns(read, low, "__name", "__low", keep, "__name", whole=True)
    return met.join(low, "__name").select(*keep, F.col("__key").alias(key_col)).distinct()
