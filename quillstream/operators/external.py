"""Calls of models and services as operators: the callable is the user's, batching, retries and errors are the engine's."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed(rows: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str, out: str = "embedding", batch: int = 64) -> DataFrame:
    """rows with a unit vector of the text (null and empty texts: null; a zero vector stays zero). encode is called with up to
    `batch` texts at once, on the executors."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            vectors: list = [None] * len(pdf)
            there = [i for i, t in enumerate(pdf[text]) if isinstance(t, str) and t]
            for k in range(0, len(there), batch):
                part = there[k : k + batch]
                v = np.asarray(encode([pdf[text].iloc[i] for i in part]), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                for i, x in zip(part, v / np.where(norm > 0, norm, 1)):
                    vectors[i] = x.tolist()
            pdf[out] = vectors
            yield pdf

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    return rows.mapInPandas(run, StructType(list(rows.schema.fields)).add(out, ArrayType(DoubleType())))


def call(rows: DataFrame, f: Callable[[dict], str], out: str = "answer", tries: int = 3, wait: float = 0.0, terminal: tuple[type, ...] = ()) -> DataFrame:
    """rows with f's answer to each row, `tries` and `error`. A row that fails is tried again after wait, 2 wait, 4 wait ...
    seconds (60 at most); a terminal kind of error ends its tries. An error fails its row only, never the batch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            answers, used, errors = [], [], []
            for row in pdf.to_dict("records"):
                answer = error = None
                for n in range(1, tries + 1):
                    try:
                        answer, error = f(row), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if isinstance(e, terminal) or n == tries:
                            break
                        time.sleep(min(wait * 2 ** (n - 1), 60.0))
                answers.append(answer)
                used.append(n)
                errors.append(error)
            yield pdf.assign(**{out: answers, "tries": used, "error": errors})

    from pyspark.sql.types import IntegerType, StringType, StructType

    schema = StructType(list(rows.schema.fields)).add(out, StringType()).add("tries", IntegerType()).add("error", StringType())
    return rows.mapInPandas(run, schema)


def call_json(rows: DataFrame, f: Callable[[dict, str | None], str], schema: str, out: str = "answer", tries: int = 3) -> DataFrame:
    """As call, for answers that hold a JSON object: the object is cut out of prose and must parse; f gets the row and the last
    bad answer (None at first), for a repair. `answer` is a struct of `schema`, null where all tries failed."""

    def ask(row: dict) -> str:
        import json

        bad = None
        for _ in range(tries):
            text = f(row, bad)
            try:
                cut = text[text.index("{") : text.rindex("}") + 1]
                json.loads(cut)
                return cut
            except ValueError:
                bad = text
        raise ValueError(f"no JSON object in {tries} answers")

    return call(rows, ask, out, 1).withColumn(out, F.from_json(out, schema))


def cached_call(rows: DataFrame, request: list[str], f: Callable[[dict], str], path: str, out: str = "answer", version: int = 1, tries: int = 3, wait: float = 0.0, terminal: tuple[type, ...] = ()) -> DataFrame:
    """rows with f's answer to their request columns and `error`, from answers stored under `path` as far as they are there.

    A request is known by the SHA-256 of its columns' JSON (nulls kept) and the version; equal requests are asked once, however many rows
    have them, and new answers are merged into the stored table once, so that a second run asks nothing. Failures aren't stored and
    are asked again next time. f gets the request columns only. Rows stay as many as they were.
    """
    from ..sources import versioned
    from .shared import durable

    spark = rows.sparkSession
    asked = F.sha2(F.concat_ws(":", F.lit(version), F.to_json(F.struct(*request), {"ignoreNullFields": "false"})), 256)
    wanted = durable(rows.select(asked.alias("__key"), *request).dropDuplicates(["__key"]))
    new = wanted
    if versioned.versions(spark, path):
        new = wanted.join(versioned.read(spark, path).select("__key"), "__key", "left_anti")
    # the answers are written before anything reads them, so that no retry asks again
    told = durable(call(new, lambda row: f({c: row[c] for c in request}), "__answer", tries, wait, terminal))
    fresh = told.where("error is null").select("__key", "__answer")
    if not fresh.isEmpty() or not versioned.versions(spark, path):
        versioned.merge(fresh, path, "__key")
    known = versioned.read(spark, path).select(F.col("__key").alias("__k"), F.col("__answer").alias(out))
    failed = told.where("error is not null").select(F.col("__key").alias("__f"), "error")
    keyed = rows.withColumn("__key", asked)
    return keyed.join(known, F.col("__key") == F.col("__k"), "left").join(failed, F.col("__key") == F.col("__f"), "left").select(*rows.columns, out, "error")


def staged(rows: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], gate: str | None = None) -> DataFrame:
    """rows through named stages, each written to the checkpoint folder. After the stage `gate` only rows whose column
    `confirmed` holds go on; the others come out as they are, `stage` telling which was the last for each."""
    from .shared import durable

    held = None
    for name, f in stages:
        rows = durable(f(rows).withColumn("stage", F.lit(name)))
        if name == gate:
            ok = F.coalesce("confirmed", F.lit(False))
            held, rows = rows.where(~ok), rows.where(ok)
    return rows if held is None else rows.unionByName(held, allowMissingColumns=True)


def similarity_score(distance: Column) -> Column:
    """0 to 100 of a distance of two images' features: 100 for none, 0 for 1 or more, and where there is none to be had."""
    usable = distance.isNotNull() & ~F.isnan(distance.cast("double"))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - distance)))).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors; null for a zero vector, and where either is null or their lengths differ."""
    from .search import dot

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def interview(subjects: DataFrame, questions: DataFrame, name: str, kind: str) -> DataFrame:
    """subjects with a row for each question that is asked of them, in order: `ladder`, `place` (1..), `question`.

    questions: ladder, kind (null: of any), place, template, in which {subject} stands for the subject's name. Questions of the own kind
    and of any are asked; a subject without a kind gets the latter only. Subjects meet questions by kind, so that none is asked in vain.
    """
    asked = questions.select("ladder", F.coalesce("kind", F.lit("")).alias("__kind"), "place", "template")
    kinds = F.array_distinct(F.array(F.lit(""), F.coalesce(F.col(kind), F.lit(""))))
    met = subjects.withColumn("__k", F.explode(kinds)).join(asked, F.col("__k") == F.col("__kind"))
    return met.select(*subjects.columns, "ladder", "place", F.replace("template", F.lit("{subject}"), F.coalesce(F.col(name), F.lit(""))).alias("question"))
