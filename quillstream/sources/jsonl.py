"""JSON Lines scans and sinks with the strictness the caller asks for."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Blank lines are skipped, CR LF ends a line like LF, a missing path is an empty table; a malformed line raises (strict) or is dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def _place(it):
    """Numbers lines within their block; a task has its blocks one after another, each in the file's order."""
    import numpy as np
    import pyarrow as pa

    last, n = None, 0
    for b in it:
        files, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = np.empty(b.num_rows, np.int64)
        for k, own in enumerate(zip(files, blocks)):
            n, last = (n + 1, last) if own == last else (1, own)
            at[k] = n
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["file", "block", "value", "at"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (1..), value of every line that isn't blank, in files of any size.

    Files are read in byte ranges, as Spark cuts them: lines are counted by range, the counts summed up along each file, and
    every line's number is its range's sum and its place there. A line ends with LF, CR LF or CR.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    placed = lines.mapInArrow(_place, "file string, block long, value string, at long").where(F.trim("value") != "")
    return placed.join(before, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", (F.col("before") + F.col("at")).alias("line"), "value")


def located_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line (1..), _bad: the text of malformed lines."""
    lines = numbered_lines(spark, path)
    return lines.withColumn("_bad", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})["_bad"]).where("_bad is not null").select("file", "line", "_bad")


def read_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a scan without errors; a malformed line raises ValueError with its file and line, the first in order."""
    bad = located_errors(spark, path, schema).orderBy("file", "line").first()
    if bad:
        raise ValueError(f"{bad.file}:{bad.line}: malformed JSON: {bad._bad[:200]}")
    return read_jsonl(spark, path, schema)


def read_indexed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One row a key, which is cast to long: the last line of each, rows whose key is none left out; malformed lines are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn(key, F.col(key).try_cast("long"))
    rows = numbered_lines(spark, path).select("file", "line", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x._bad is null")
    keyed = rows.withColumn("k", F.col(f"x.{key}").cast("string").try_cast("long")).where("k is not null")
    last = keyed.groupBy("k").agg(F.max_by("x", F.struct("file", "line")).alias("x"))
    fields = [c for c in spark.createDataFrame([], schema).columns if c != key]
    return last.select(F.col("k").alias(key), *[F.col(f"x.{c}").alias(c) for c in fields])


def split_summary(rows: DataFrame, mark: str = "scene_index") -> tuple[DataFrame, DataFrame]:
    """(rows without the mark: the summary, rows with it)."""
    return rows.where(F.col(mark).isNull()), rows.where(F.col(mark).isNotNull())


def read_scenes(spark: SparkSession, path: str, schema: str, mark: str = "scene_index") -> DataFrame:
    """The rows with the mark, by it; when run, a row without that isn't its file's first line raises."""
    rows = numbered_lines(spark, path).select("file", "line", F.from_json("value", schema).alias("x"))
    wrong = F.col(f"x.{mark}").isNull() & (F.col("line") > 1)
    told = F.concat(F.col("file"), F.lit(":"), F.col("line"), F.lit(f": no {mark}"))
    checked = rows.where(F.when(wrong, F.raise_error(told).cast("boolean")).otherwise(F.col(f"x.{mark}").isNotNull()))
    return checked.select("x.*").orderBy(mark)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """key, value (JSON text; texts without quotes) of the objects in a file or a folder of JSON files; no rows where there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return whole.select(F.explode("m").alias("key", "value"))


def confirmations(config: DataFrame) -> DataFrame:
    """key, id of a config whose values are lists of ids; other values have no rows."""
    return config.select("key", F.explode(F.from_json("value", "array<string>")).alias("id"))


def load_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """name -> frame of the Parquet tables in a folder; missing ones raise KeyError with their names."""
    lost = [n for n in names if not exists(spark, f"{folder}/{n}.parquet")]
    if lost:
        raise KeyError(", ".join(lost))
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def read_images(spark: SparkSession, path: str, root: str, most: int = 20 << 20, glob: str = "*") -> DataFrame:
    """path, length, sha256 of the files under `path` of at most `most` bytes. A path outside `root` raises ValueError."""
    import posixpath

    inside, base = posixpath.normpath(path.replace("\\", "/")), posixpath.normpath(root.replace("\\", "/"))
    if inside != base and not inside.startswith(base + "/"):
        raise ValueError(f"{path} lies outside {root}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(inside).where(F.col("length") <= most)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def event_text(lines: DataFrame, key: list[str], order: str, value: str = "value") -> DataFrame:
    """key, text, ended: streamed JSON events (event_type text or end) as one text in order, and whether the end came. Other
    lines are skipped."""
    e = F.from_json(F.col(value), "event_type string, text string")
    rows = lines.select(*key, order, e.alias("e")).where(F.col("e.event_type").isNotNull())
    said = F.when((F.col("e.event_type") == "text") & F.col("e.text").isNotNull(), F.struct(F.col(order).alias("o"), F.col("e.text").alias("t")))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), "").alias("text"), F.max(F.col("e.event_type") == "end").alias("ended"))


def registry(rows: DataFrame, name: str, default: str) -> DataFrame:
    """The rows with a name, trimmed; one row of the default name where there are none."""
    named = rows.withColumn(name, F.trim(F.col(name))).where(F.coalesce(F.col(name), F.lit("")) != "")
    n = named.agg(F.count(F.lit(1)).alias("__n")).where("__n = 0").select(F.lit(default).alias(name))
    return named.unionByName(n, allowMissingColumns=True)


def swap(spark: SparkSession, staged: str, path: str, backup: str | None = None) -> None:
    """Puts a finished folder in the place of another by two renames; the old one is deleted, or becomes the backup.

    Readers see the old or the new folder, or for a moment none; never a part of either.
    """
    fs, new = _fs(spark, staged)
    at, old = _fs(spark, path)[1], _fs(spark, backup or f"{path}.old-{uuid.uuid4().hex}")[1]
    if backup and fs.exists(old):
        fs.delete(old, True)
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{staged} can't be moved to {path}")
    if not backup:
        fs.delete(old, True)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, append: bool = False) -> None:
    """Appends by Spark's task and job commits, or replaces the folder: the new one is written beside it and then swapped in,
    so that a failed write leaves the old one. With an order, files and rows are range-sorted."""
    df = df.orderBy(*order) if order else df
    if append:
        df.write.mode("append").json(path)
        return
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.json(staged)
    swap(df.sparkSession, staged, path)


def rebuild(df: DataFrame, path: str, check=None) -> None:
    """Replaces a Parquet folder by a new build and keeps the previous one as `path`.previous; `check` gets the new frame and
    may raise before anything is replaced."""
    spark, staged = df.sparkSession, f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if check:
        check(spark.read.parquet(staged))
    swap(spark, staged, path, f"{path}.previous")


#: Seconds after which a writer's lock counts as left behind.
LEASE = 3600.0


def upsert_file(spark: SparkSession, path: str, changes: DataFrame, key: list[str], lease: float = LEASE) -> DataFrame:
    """Read, merge (last wins), replace; one writer at a time, which a lock file beside the folder ensures. Returns the new table.

    A lock older than the lease, such as a crashed writer's, is moved away by one rename, which only one of several writers succeeds with.
    sources.versioned has tables whose writers need no lock.
    """
    import time

    from ..operators import records

    fs, lock = _fs(spark, f"{path}.lock")
    if not fs.createNewFile(lock):
        aside = _fs(spark, f"{path}.lock-{uuid.uuid4().hex}")[1]
        if fs.exists(lock) and time.time() - fs.getFileStatus(lock).getModificationTime() / 1000 > lease and fs.rename(lock, aside):
            fs.delete(aside, False)
        if not fs.createNewFile(lock):
            raise BlockingIOError(f"{path} is being written")
    try:
        schema = changes.schema
        base = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
        write_jsonl(records.upsert(base, changes, key), path)
        return spark.read.schema(schema).json(path)
    finally:
        fs.delete(lock, False)


def counts_json(counts: DataFrame, label: str, n: str) -> DataFrame:
    """One row: the counts as a JSON object, labels in order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), F.col(n).alias("n"))))
    return counts.agg(F.to_json(F.map_from_entries(items)).alias("json"))


def referenced(rows: DataFrame, columns: list[str], suffixes: tuple[str, ...] = (".png", ".jpg", ".mp4", ".webm")) -> DataFrame:
    """path: the distinct media paths, sorted, that text and array columns name, without queries and fragments."""
    parts = [F.coalesce(F.col(c), F.array().cast("array<string>")) if rows.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string")) for c in columns]
    every = rows.select(F.explode(F.concat(*parts)).alias("p")).select(F.regexp_replace("p", r"[?#].*$", "").alias("path"))
    hit = None
    for s in suffixes:
        hit = F.lower("path").endswith(s) if hit is None else hit | F.lower("path").endswith(s)
    return every.where(hit).distinct().orderBy("path")


def report(rows: DataFrame, columns: list[tuple[str, str, int]], order: list[str], title: str) -> DataFrame:
    """value: lines of fixed width, in order: the title, a head, a rule and a line a row. columns: (column, head, width); longer
    values are cut."""
    cell = lambda c, w: F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ")
    body = rows.orderBy(*order).select(F.concat_ws(" ", *[cell(c, w) for c, _, w in columns]).alias("value"), F.struct(F.lit(1).alias("k"), *order).alias("o"))
    head = " ".join(h[:w].ljust(w) for _, h, w in columns)
    top = rows.sparkSession.createDataFrame([(title, 0), (head, 1), ("-" * len(head), 2)], "value string, n int")
    first = top.withColumn("g", F.lit(0)).select("g", "n", F.lit(None).cast(body.schema["o"].dataType).alias("o"), "value")
    return first.unionByName(body.select(F.lit(1).alias("g"), F.lit(0).alias("n"), "o", "value")).orderBy("g", "n", "o").select("value")


def inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of files, without reading their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files of an inventory that are new or whose length or time differs."""
    old = before.select("path", F.col("length").alias("__l"), F.col("modificationTime").alias("__m"))
    same: Column = F.col("length").eqNullSafe(F.col("__l")) & F.col("modificationTime").eqNullSafe(F.col("__m"))
    return now.join(old, "path", "left").where(~same).drop("__l", "__m")


def signature(files: DataFrame) -> tuple:
    """(files, bytes, a hash of all paths, sizes and times) of an inventory."""
    each = F.xxhash64("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.bit_xor(each), F.lit(0))).first())


def poll(spark: SparkSession, path: str, rebuild, seconds: float = 30.0, glob: str = "*", until=lambda looks: False) -> int:
    """Looks at the files under `path` every so many seconds, and calls rebuild(files) at the first look and whenever a size or a time has changed.

    until(number of looks) ends it; gives how often was rebuilt. A path that isn't there has no files. If rebuild raises, so does this.
    """
    import time

    last, looks, built = None, 0, 0
    while True:
        files = inventory(spark, path, glob) if exists(spark, path) else spark.createDataFrame([], "path string, length long, modificationTime timestamp")
        now, looks = signature(files), looks + 1
        if now != last:
            rebuild(files)
            last, built = now, built + 1
        if until(looks):
            return built
        time.sleep(seconds)
