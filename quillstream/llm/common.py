"""What several operators of this package share: words, tables, durable intermediates."""

from __future__ import annotations

import contextlib
import ctypes
import string
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The same class in the ids that Java's and DuckDB's regular expressions share.
BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; other letters keep their case."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A temporary one only where nothing is set and Spark runs on one machine."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = known.get() if known.isDefined() else tempfile.mkdtemp(prefix="quillstream-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared)
    return shared


def durable(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs no recomputation.

    For narrow tables that are read more than once. Spark removes the files when the frame is collected
    as garbage (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared checkpoint folder, read again: lineage is cut as in durable(), columns are compressed.

    For tables that are read more than once and of which a reader wants some columns or rows only. They stay there until
    that folder is cleaned, or until discard() removes them. codec: Parquet's compression, else the session's.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the stored tables that `df` reads, which nobody may read any more; frames of other files are left as they are."""
    jvm, known = df.sparkSession._jvm, set()
    for x in df.inputFiles():
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)).getParent()
        if at.getName().startswith("stored-") and at.toString() not in known:
            known.add(at.toString())
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    return h ^ (h >> np.uint64(29))


def windows5(h: np.ndarray, width: int = 5) -> np.ndarray:
    """One 64-bit hash for each run of `width` words, from the words' hashes; needs len(h) >= width."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= _M1
        out ^= h[k : k + n]
        out ^= out >> np.uint64(32)
    return mix(out)


#: Bytes whose words are hashed at once; a longer text is one piece of its own.
_CHUNK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(_CHUNK, n) + 1
        base = 0x9E3779B97F4A7C15
        _POWERS[:] = [np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def hashed_words(col: pa.Array, lower: bool):
    """For each run of rows of an Arrow string column: (rows in it, hashes of all their words, first word of each row).

    Words are hashed from the column's own bytes, a run of rows at a time: a prefix sum of byte codes times powers
    gives every word's polynomial hash by one subtraction. lower: A-Z counts as a-z.
    """
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    code, i = _LOWER if lower else _BYTES, 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _CHUNK, side="right")) - 1)
        piece, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = len(piece)
        if not n:
            yield j - i, np.empty(0, np.uint64), np.zeros(j - i + 1, np.int64)
            i = j
            continue
        ink = ~_BLANK[piece]
        start, end, edge = ink.copy(), ink.copy(), at[(at > 0) & (at < n)]
        start[1:] &= ~ink[:-1]
        start[edge] = ink[edge]
        end[:-1] &= ~ink[1:]
        end[edge - 1] = ink[edge - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        power, inverse = _powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(code[piece] * power[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M1)
        yield j - i, h, np.searchsorted(starts, at)
        i = j


def shingle_sets(col: pa.Array, width: int = 5):
    """Per row: sorted distinct hashes of its lower-cased shingles; fewer words than `width` make one, none make none."""
    for rows, h, first in hashed_words(col, True):
        w = windows5(h, width) if len(h) >= width else None
        for k in range(rows):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= width:
                s = np.sort(w[a : b - width + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                whole = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for x in h[a:b]:
                        whole = (whole * _M1) ^ x
                        whole ^= whole >> np.uint64(32)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)


#: Rows that a worker turns into Python objects at once.
ROWS = 1_000


def trim() -> None:
    """Gives what a task has freed back to the system: workers outlive their tasks, and share a machine with the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about `most` bytes for the jobs run inside, whatever rows hold: what a task has before it, several times over, follows from that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def batches(it: Iterator[pa.RecordBatch], schema: pa.Schema, f) -> Iterator[pa.RecordBatch]:
    """Applies f(Arrow columns by name) -> columns by name to ROWS rows of the Arrow batches at a time."""
    for whole in it:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            out = f({n: b.column(i) for i, n in enumerate(b.schema.names)})
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((out[n] for n in schema.names), schema)], schema=schema)
    trim()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle and checkpoint files of frames that nobody holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Up to so many edges (two short keys each) go through their rounds in one task, which needs no shuffle.
FEW_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges a-b: the smallest node of its connected component.

    Alternates large-star and small-star rounds until the edges are stars, which takes a number of rounds
    logarithmic in the longest path. Each round joins edges to their nodes' minima, aggregated on the map
    side first, so a node with very many edges is split like any skewed join. Counted edges of FEW_EDGES or fewer
    stand in one partition, where the same rounds have nothing to exchange. Self-loops and null ends are
    ignored; no edges: empty.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = durable(e)
    n = e.count()
    whole = (lambda df: df.coalesce(1)) if n <= FEW_EDGES else (lambda df: df)
    e = whole(e)
    while n:
        # large-star: every larger neighbour of u goes to the least of u's neighbourhood
        both = whole(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: u and its smaller neighbours go to the least of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = durable(whole(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v")))).distinct())
        before, n = n, new.count()
        if n == before and new.join(e, ["u", "v"], "left_anti").isEmpty():
            break
        e = whole(new)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return durable(whole(stars.unionByName(stars.select(F.col("label").alias("node"), "label"))).distinct())
