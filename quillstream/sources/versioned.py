"""Stored tables in versions: replacement without a gap, merges that rewrite only the files they touch, commits by compare-and-set.

A table is a folder of Parquet files and of manifests, one for each version, which list a version's files with the range of the keys in
each. Files of a version have disjoint ranges and are never changed. The greatest version is the table: a commit is the creation of the next
manifest, which fails if somebody else was first. Readers hold on to the files of the version that they began with.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import records
from .jsonl import _fs

#: Rows of a file that a merge writes, about; how often a merge begins again after others were first.
FILE_ROWS, TRIES = 1_000_000, 20


class Conflict(Exception):
    """Another writer has committed since this one read the table."""


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions there are, in order."""
    fs, at = _fs(spark, f"{path}/versions")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n[:12]) for n in names if n[:12].isdigit() and n.endswith(".json") and len(n) == 17)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """A version's manifest (version, schema, key, files: path, low, high, rows), by default the last one's; version 0 has no files."""
    there = versions(spark, path)
    version = (there[-1] if there else 0) if version is None else version
    if not version:
        return {"version": 0, "schema": None, "key": None, "files": []}
    return json.loads(spark.read.text(_manifest(path, version), wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, made: dict) -> None:
    """Creates the manifest of made["version"], whole or not at all; Conflict if it is there."""
    fs, target = _fs(spark, _manifest(path, made["version"]))
    _, temp = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(temp, False)
    out.write(json.dumps(made).encode())
    out.close()
    try:
        if fs.getScheme() == "file":  # its rename would replace the other's manifest
            os.link(temp.toUri().getPath(), target.toUri().getPath())
        elif fs.exists(target) or not fs.rename(temp, target):
            raise Conflict(made["version"])
    except FileExistsError:
        raise Conflict(made["version"]) from None
    finally:
        fs.delete(temp, False)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the last; KeyError where there is no table."""
    m = manifest(spark, path, version)
    if not m["version"]:
        raise KeyError(path)
    schema = StructType.fromJson(m["schema"])
    return spark.read.schema(schema).parquet(*[f"{path}/{f['path']}" for f in m["files"]]) if m["files"] else spark.createDataFrame([], schema)


def _written(rows: DataFrame, path: str, key: str, count: int) -> list[dict]:
    """Writes rows with a column `__slot`, files being ranges of (slot, key), and gives their entries."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(max(1, -(-count // FILE_ROWS)), "__slot", key).sortWithinPartitions("__slot", key)
    dealt.write.partitionBy("__slot").parquet(f"{path}/{folder}")
    if not _has_parts(spark, f"{path}/{folder}"):
        return []
    seen = spark.read.parquet(f"{path}/{folder}").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows")).collect()
    return sorted(({"path": folder + "/" + r.f.split(folder + "/", 1)[1], "low": r.low, "high": r.high, "rows": r.rows} for r in seen), key=lambda e: e["low"])


def _has_parts(spark: SparkSession, folder: str) -> bool:
    """Whether a folder has a part."""
    fs, at = _fs(spark, folder)
    return any(s.isDirectory() for s in fs.listStatus(at))


def _checked(rows: DataFrame, key: str) -> int:
    """The number of rows; a null or repeated key raises."""
    n, some, distinct = rows.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
    if n != some or n != distinct:
        raise ValueError(f"{key} must be there and differ in every row")
    return n


def replace(rows: DataFrame, path: str, key: str) -> int:
    """Makes `rows` the table, whatever it was before; gives the version. Readers see the old table or the new one, never none.

    key: one column of whole numbers or texts, not null, one row each. Files of earlier versions stay until vacuum.
    """
    spark, n = rows.sparkSession, _checked(rows, key)
    files = _written(rows.withColumn("__slot", F.lit(0)), path, key, n)
    while True:
        version = manifest(spark, path)["version"] + 1
        try:
            _commit(spark, path, {"version": version, "schema": rows.schema.jsonValue(), "key": key, "files": files})
            return version
        except Conflict:
            continue


def _slots(lows: list, key: str):
    """Adds the file whose range a key belongs to: the last that begins at or below it, else the first."""
    kind = pa.int32()
    bounds = np.array(lows, dtype=object if lows and isinstance(lows[0], str) else np.int64)

    def run(it):
        for b in it:
            keys = np.array(b.column(b.schema.get_field_index(key)).to_pylist(), dtype=bounds.dtype)
            at = np.maximum(np.searchsorted(bounds, keys, side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32), kind)], names=[*b.schema.names, "__slot"])

    return run


def _placed(rows: DataFrame, lows: list, key: str) -> DataFrame:
    kind = StructType([*rows.schema.fields, StructField("__slot", IntegerType())])
    return rows.mapInArrow(_slots(lows, key), kind)


def merge(changes: DataFrame, path: str, key: str, fields: bool = False, deleted: str | None = None, before_commit: Callable[[], None] | None = None) -> tuple[int, int]:
    """Puts `changes` into the table; gives (version, files that were rewritten). Only files in whose range a changed key lies are read and written.

    A change replaces its key's row or adds one; fields: its values that aren't null are set, others stay. deleted: a boolean column of the
    changes that isn't one of the table's; where it holds the row goes. changes have a key each, not null. No table: the changes
    become it. If others commit meanwhile, the merge begins again with their version. No changes: nothing is committed.
    """
    from ..operators.shared import durable

    spark = changes.sparkSession
    changes = durable(changes)
    n = _checked(changes, key)
    for _ in range(TRIES):
        old = manifest(spark, path)
        if old["version"] and not n:
            return old["version"], 0
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        if not old["files"]:
            kept = changes.where(~gone)
            made = _written((kept.drop(deleted) if deleted else kept).withColumn("__slot", F.lit(0)), path, key, n)
            schema, untouched, rewritten = old["schema"] or (changes.drop(deleted) if deleted else changes).schema.jsonValue(), [], 0
        else:
            if old["key"] != key:
                raise ValueError(f"the table's key is {old['key']}")
            lows = [f["low"] for f in old["files"]]
            placed = durable(_placed(changes, lows, key))
            touched = sorted(r[0] for r in placed.select("__slot").distinct().collect())
            files, schema = [old["files"][k] for k in touched], old["schema"]
            untouched, rewritten = [f for k, f in enumerate(old["files"]) if k not in set(touched)], len(files)
            rows = _placed(spark.read.schema(StructType.fromJson(schema)).parquet(*[f"{path}/{f['path']}" for f in files]), lows, key)
            stay = rows.join(changes.where(gone).select(key), key, "left_anti") if deleted else rows
            new = placed.where(~gone).drop(deleted) if deleted else placed
            both = (records.update_fields if fields else records.upsert)(stay, new, [key]).select(*rows.columns)
            made = _written(both, path, key, n + sum(f["rows"] for f in files))
        if before_commit:
            before_commit()
        try:
            _commit(spark, path, {"version": old["version"] + 1, "schema": schema, "key": key, "files": sorted(untouched + made, key=lambda f: f["low"])})
            return old["version"] + 1, rewritten
        except Conflict:
            continue
    raise Conflict(path)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests before the last `keep`, and files that no kept one names; gives how many files went. Not beside a running write."""
    there = versions(spark, path)
    held = {f["path"] for v in there[-keep:] for f in manifest(spark, path, v)["files"]}
    fs, data = _fs(spark, f"{path}/data")
    files, gone = fs.listFiles(data, True) if fs.exists(data) else None, []
    while files and files.hasNext():
        at = files.next().getPath()
        name = at.toString().rsplit("/data/", 1)[1]
        if at.getName().startswith("part-") and f"data/{name}" not in held:
            gone.append(at)
    for v in there[:-keep]:
        fs.delete(_fs(spark, _manifest(path, v))[1], False)
    for at in gone:
        fs.delete(at, False)
    return len(gone)
