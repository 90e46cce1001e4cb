"""Queries of scans, sinks, calls and streams: tables go out to files or services and come back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import external
from ..operators.ivf import index_path
from ..sources import jsonl
from ..streaming import keyed, turns
from .catalog import register, t

_TURNS = "conv_id long, turn long, role string"


@register("SELECT conv_id, turn, role FROM conversations")
def jsonl_replace(spark, d):
    """Written twice in order; the second replaces the first. Blank lines that a sink of text adds are skipped."""
    path, c = index_path(spark, "jsonl"), t(spark, d, "conversations").select("conv_id", "turn", "role")
    jsonl.write_jsonl(c.where("turn = 1"), path)
    jsonl.write_jsonl(c, path, ["conv_id", "turn"])
    c.select(F.lit("  ").alias("value")).distinct().write.mode("append").text(path)
    return jsonl.read_jsonl(spark, path, _TURNS)


@register("SELECT conv_id, turn, role FROM conversations")
def jsonl_append(spark, d):
    path, c = index_path(spark, "jsonl"), t(spark, d, "conversations").select("conv_id", "turn", "role")
    for k in range(2):
        jsonl.write_jsonl(c.where(F.col("turn") % 2 == k), path, append=True)
    return jsonl.read_jsonl(spark, path, _TURNS)


@register("SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 0")
def jsonl_dropped(spark, d):
    """Every third line is cut off in the middle, and isn't read."""
    path, line = index_path(spark, "jsonl"), "to_json(struct(conv_id, turn))"
    t(spark, d, "conversations").select(F.expr(f"if(turn % 3 = 0, left({line}, length({line}) - 1), {line})").alias("value")).write.text(path)
    return jsonl.read_jsonl(spark, path, "conv_id long, turn long", strict=False)


@register("SELECT o_orderkey AS key, o_orderstatus AS status FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0")
def indexed_scan(spark, d):
    """Keys are texts in the file; those that are null or no number are left out."""
    path, k = index_path(spark, "jsonl"), F.col("o_orderkey")
    key = F.when(k % 4 == 0, None).when(k % 7 == 0, "n/a").otherwise(k.cast("string"))
    jsonl.write_jsonl(t(spark, d, "orders").select(key.alias("key"), F.col("o_orderstatus").alias("status")), path)
    return jsonl.read_indexed(spark, path, "key string, status string", "key")


@register("SELECT o_orderkey AS scene_index, o_totalprice AS duration FROM orders")
def scene_scan(spark, d):
    path = index_path(spark, "jsonl")
    jsonl.write_jsonl(t(spark, d, "orders").select(F.col("o_orderkey").alias("scene_index"), F.col("o_totalprice").alias("duration")), path)
    return jsonl.read_scenes(spark, path, "scene_index long, duration double")


@register("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'summary' ELSE 'scene' END AS kind FROM events")
def summary_split(spark, d):
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id")).alias("scene_index"))
    summary, scenes = jsonl.split_summary(rows)
    return summary.select("event_id", F.lit("summary").alias("kind")).unionByName(scenes.select("event_id", F.lit("scene").alias("kind")))


@register("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def index_load(spark, d):
    found = jsonl.load_index(spark, d, ["nation", "region"])
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@register("SELECT conv_id, coalesce(string_agg(text, '' ORDER BY turn), '') AS text, conv_id % 2 = 0 AS ended FROM conversations GROUP BY conv_id")
def streamed_text(spark, d):
    """Turns as streamed events, with an end for every second conversation and a line that isn't an event."""
    c = t(spark, d, "conversations")
    said = c.select("conv_id", "turn", F.to_json(F.struct(F.lit("text").alias("event_type"), "text")).alias("value"))
    ends = c.where("conv_id % 2 = 0").select("conv_id").distinct().select("conv_id", F.lit(1_000_000).cast("long").alias("turn"), F.lit('{"event_type":"end"}').alias("value"))
    other = c.select("conv_id", "turn", F.lit("event: ping").alias("value"))
    return jsonl.event_text(said.unionByName(ends).unionByName(other), ["conv_id"], "turn")


@register("SELECT c_custkey, trim(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0")
def batch_registry(spark, d):
    name = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ")))
    return jsonl.registry(t(spark, d, "customer").select("c_custkey", name.alias("name")), "name", "default").select("c_custkey", "name")


@register("""SELECT '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS json FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)""")
def counts_export(spark, d):
    return jsonl.counts_json(t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "o_orderstatus", "n")


@register("SELECT DISTINCT replace(p_brand, '#', '') || '/' || p_size || '.PNG' AS path FROM part UNION SELECT DISTINCT p_type || '.mp4' FROM part")
def media_references(spark, d):
    p = t(spark, d, "part").select(F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/"), "p_size", F.lit(".PNG?v="), "p_partkey").alias("image"), F.array(F.concat("p_type", F.lit(".mp4#t=1")), F.col("p_name")).alias("media"))
    return jsonl.referenced(p, ["image", "media"])


@register("SELECT 'orders' AS value UNION ALL SELECT 'status  coun' UNION ALL SELECT '------------' UNION ALL SELECT rpad(o_orderstatus, 7, ' ') || ' ' || rpad(left(count(*)::VARCHAR, 4), 4, ' ') FROM orders GROUP BY o_orderstatus")
def fixed_report(spark, d):
    counts = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return jsonl.report(counts, [("o_orderstatus", "status", 7), ("n", "count", 4)], ["o_orderstatus"], "orders")


@register("SELECT o_orderkey, 'now' AS build FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'previous' FROM orders")
def staged_rebuild(spark, d):
    path, o = index_path(spark, "rebuilt"), t(spark, d, "orders").select("o_orderkey")
    jsonl.rebuild(o, path)
    jsonl.rebuild(o.where("o_orderkey % 2 = 0"), path)
    return spark.read.parquet(path).withColumn("build", F.lit("now")).unionByName(spark.read.parquet(f"{path}.previous").withColumn("build", F.lit("previous")))


@register("""WITH c AS (SELECT conv_id, turn, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS b FROM conversations WHERE text <> '')
SELECT conv_id, turn, round(CASE WHEN a + b > 0 THEN a / sqrt(a * a + b * b) ELSE 0 END, 9) AS x, round(CASE WHEN a + b > 0 THEN b / sqrt(a * a + b * b) ELSE 0 END, 9) AS y FROM c""")
def embedded_texts(spark, d):
    """Unit vectors of (characters, letters e) by a callable on the executors."""
    rows = t(spark, d, "conversations").where("text <> ''").select("conv_id", "turn", "text")
    e = external.embed(rows, lambda texts: np.array([[len(x), x.count("e")] for x in texts]), "text")
    return e.select("conv_id", "turn", F.round(F.col("embedding")[0], 9).alias("x"), F.round(F.col("embedding")[1], 9).alias("y"))


def _graded(row: dict) -> str:
    if row["c_custkey"] % 7 == 0:
        raise KeyError("never")
    if row["c_custkey"] % 5 == 0:
        raise TimeoutError("busy")
    return row["c_name"].upper()


@register("""SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 THEN upper(c_name) END AS answer, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 3 ELSE 1 END AS tries,
CASE WHEN c_custkey % 7 = 0 THEN 'KeyError: ''never''' WHEN c_custkey % 5 = 0 THEN 'TimeoutError: busy' END AS error FROM customer""")
def graded_calls(spark, d):
    """Calls of which some fail for good, some after three tries; every row keeps its own error."""
    return external.call(t(spark, d, "customer").select("c_custkey", "c_name"), _graded, terminal=(KeyError,)).select("c_custkey", "answer", "tries", "error")


def _repaired(row: dict, bad: str | None) -> str:
    return f"So: {{\"k\": {row['c_custkey']}}}." if row["c_custkey"] % 2 or bad else "nothing yet"


@register("SELECT c_custkey, c_custkey AS k FROM customer")
def repaired_json(spark, d):
    """Every second answer has no JSON object at first and is asked for again."""
    return external.call_json(t(spark, d, "customer").select("c_custkey"), _repaired, "k long").select("c_custkey", "answer.k")


@register("SELECT c_custkey, upper(c_mktsegment) AS answer, NULL::VARCHAR AS error FROM customer")
def cached_answers(spark, d):
    """Two runs over customers' segments: each segment is asked for once, the second run reads what the first has stored."""
    path, rows = index_path(spark, "answers"), t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    for part in (rows.where("c_custkey % 2 = 0"), rows):
        out = external.cached_call(part, ["c_mktsegment"], lambda row: row["c_mktsegment"].upper(), path)
    return out.select("c_custkey", "answer", "error")


_LATE = "epoch_ms(ts) + 1 <= (SELECT max(epoch_ms(ts)) FROM events) - 3600000"


def _streamed(spark, d, f, schema: str):
    """What a stream over the events tells until it has read all there are, by way of an append-only log.

    A table's files come in any order, so they are one batch, of which no event is late.
    """
    keyed.prepare(spark)
    path = index_path(spark, "stream")
    turns.append_log(f(turns.stream_parquet(spark, f"{d}/events.parquet", None)), f"{path}/out", f"{path}/state").awaitTermination()
    return jsonl.read_jsonl(spark, f"{path}/out", schema)


@register(f"""WITH RECURSIVE o AS (SELECT user_id AS k, event_id, coalesce(value, 0) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE {_LATE}),
f AS (SELECT k, event_id, i, v AS used, 0::BIGINT AS part FROM o WHERE i = 1
 UNION ALL SELECT o.k, o.event_id, o.i, CASE WHEN f.used > 0 AND f.used + o.v > 300 THEN o.v ELSE f.used + o.v END, f.part + (f.used > 0 AND f.used + o.v > 300)::INT FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS key, event_id AS id, part FROM f""")
def streamed_partitions(spark, d):
    """Greedy partitions of a value of 300 of each user's events, those that the watermark has passed."""
    return _streamed(spark, d, lambda e: keyed.budget_partitions(e, "value", 300.0, "1 hour"), "key long, id long, part long")


@register(f"""WITH l AS (SELECT *, epoch(ts) AS s, lag(event_type) OVER w AS pk, lag(epoch(ts)) OVER w AS pe FROM events WHERE {_LATE} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum((pk IS NULL OR pk <> event_type OR s - pe > 21600)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM l),
g AS (SELECT user_id AS key, turn, min(event_type) AS kind, min(s) AS start, max(s) AS "end", count(*) AS n, turn = max(turn) OVER (PARTITION BY user_id) AS last FROM n GROUP BY user_id, turn)
SELECT key, kind, round(start, 3) AS start, round("end", 3) AS "end", n FROM g WHERE NOT last OR ("end" + 21600 < (SELECT max(epoch_ms(ts)) FROM events) / 1000.0 - 3600
 AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = key AND epoch(e.ts) > "end"))""")
def streamed_turns(spark, d):
    """Turns of each user that have ended before the watermark."""
    out = _streamed(spark, d, lambda e: keyed.turns(e, 21_600.0, "1 hour"), "key long, kind string, start double, end double, n long")
    return out.select("key", "kind", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'made' ELSE event_type END AS text, CASE WHEN event_id % 3 = 0 THEN 'make' ELSE 'look' END AS stage FROM events""")
def staged_calls(spark, d):
    """Two stages, of which the second sees only what the first has confirmed."""
    stages = [("look", lambda x: x.withColumn("confirmed", F.col("event_id") % 3 == 0)), ("make", lambda x: x.withColumn("text", F.lit("made")))]
    rows = t(spark, d, "events").select("event_id", F.col("event_type").alias("text"))
    return external.staged(rows, stages, gate="look").select("event_id", "text", "stage")


_MARK = "(SELECT max(epoch_ms(ts)) FROM events) - 86400000"


def _seconds(c: str):
    return F.round(F.unix_micros(F.col(c)) / 1e6, 3).alias(c)


@register(f"""WITH w AS (SELECT unnest(range(floor((epoch_ms(ts) - 900000) / 780000)::BIGINT + 1, floor(epoch_ms(ts) / 780000)::BIGINT + 1)) * 780000 AS start FROM events)
SELECT start / 1000.0 AS start, (start + 900000) / 1000.0 AS "end", count(*) AS n FROM w GROUP BY start HAVING start + 900000 <= {_MARK}""")
def streamed_windows(spark, d):
    """Windows of fifteen minutes every thirteen, those that a watermark of a day has passed."""
    out = _streamed(spark, d, lambda e: turns.sliding(e, early=True), "start timestamp, end timestamp, n long")
    return out.select(_seconds("start"), _seconds("end"), "n")


@register(f"""WITH l AS (SELECT user_id, epoch_us(ts) // 1000 AS s, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
n AS (SELECT user_id, s, sum((before IS NULL OR s - before >= 21600000)::INT) OVER (PARTITION BY user_id ORDER BY s) AS k FROM l)
SELECT user_id, min(s) / 1000.0 AS start, (max(s) + 21600000) / 1000.0 AS "end", count(*) AS n FROM n GROUP BY user_id, k HAVING max(s) + 21600000 <= {_MARK}""")
def streamed_sessions(spark, d):
    """Sessions of each user by a gap of six hours, those that a watermark of a day has passed."""
    out = _streamed(spark, d, lambda e: turns.sessions(e, early=True), "user_id long, start timestamp, end timestamp, n long")
    return out.select("user_id", _seconds("start"), _seconds("end"), "n")  # the log has thousandths
