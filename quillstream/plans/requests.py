"""Queries of requests, configurations, scores, scenes and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import context, external, folds, lookup, media, select
from ..operators.ivf import index_path
from ..sources import jsonl
from .catalog import register, t


@register("""SELECT conv_id, turn, concat_ws(chr(10), 'ROLE: ' || role, 'DIALOGUE: ' || CASE WHEN text <> '' AND turn % 2 = 0 THEN text END, 'TURN: ' || turn) AS query,
coalesce(CASE WHEN text <> '' AND turn % 2 = 0 THEN text END, concat_ws(chr(10), 'ROLE: ' || role, 'TURN: ' || turn)) AS focus FROM conversations""")
def assembled_query(spark, d):
    """Labelled parts of every turn; every second one has no dialogue, and its whole query is the focus."""
    said = F.when(F.col("turn") % 2 == 0, F.col("text"))
    q = context.query_text([("ROLE", F.col("role")), ("DIALOGUE", said), ("TURN", F.col("turn").cast("string"))], ["DIALOGUE"])
    return t(spark, d, "conversations").select("conv_id", "turn", q.alias("q")).select("conv_id", "turn", "q.*")


@register("""SELECT event_id, concat_ws('; ', CASE WHEN event_type = 'click' THEN 'one of name, note is needed' END, CASE WHEN NOT value BETWEEN 1 AND 10 THEN 'value must lie between 1 and 10' END) AS errors FROM events""")
def checked_requests(spark, d):
    e = t(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "click", "  ").otherwise(F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("note"))
    return select.check_request(e, ["name", "note"], {"value": (1, 10)}).select("event_id", F.array_join("errors", "; ").alias("errors"))


@register("""SELECT a.vec_id, round(greatest(0, least(100, 100 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def similarity_scores(spark, d):
    """0 to 100 of each vector and the next one."""
    e = t(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", F.round(external.similarity_score(external.cosine_distance(F.col("embedding"), F.col("other"))), 6).alias("score"))


_ASKED = [("CQ", None, 1, "What is {subject}?"), ("P", "BUILDING", 1, "Who built {subject}?"), ("P", "BUILDING", 2, "When?"), ("A", "MACHINERY", 1, "What moves {subject}?")]


@register("""SELECT c_custkey, 'CQ' AS ladder, 1 AS place, 'What is ' || c_name || '?' AS question FROM customer UNION ALL SELECT c_custkey, 'P', 1, 'Who built ' || c_name || '?' FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT c_custkey, 'P', 2, 'When?' FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'A', 1, 'What moves ' || c_name || '?' FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def interview_questions(spark, d):
    questions = spark.createDataFrame(_ASKED, "ladder string, kind string, place int, template string")
    return external.interview(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), questions, "c_name", "c_mktsegment").select("c_custkey", "ladder", "place", "question")


@register("SELECT n_name AS key, unnest(list(c_custkey::VARCHAR)) AS id FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def config_entries(spark, d):
    """Customers by nation, written as JSON objects of id lists beside a field that is none, and read as configuration."""
    path = index_path(spark, "config")
    by = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_name").agg(F.collect_list(F.col("c_custkey").cast("string")).alias("ids"))
    by.select(F.concat(F.lit('{"note": "none", '), F.expr("substring(to_json(map(n_name, ids)), 2)")).alias("value")).repartition(4).write.option("lineSep", "\n").text(path)
    lines = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("key", "value"))
    return jsonl.confirmations(lines)


@register("""WITH RECURSIVE o AS (SELECT user_id AS u, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT u, n, 0::BIGINT AS i, 0::BIGINT AS start FROM o WHERE i = 0 UNION ALL SELECT o.u, o.n, o.i, CASE WHEN o.v > 15 AND o.i - f.start >= 3 THEN o.i ELSE f.start END FROM f JOIN o ON o.u = f.u AND o.i = f.i + 1),
g AS (SELECT DISTINCT u, n, start FROM f), h AS (SELECT u, n, start AS first, coalesce(lead(start) OVER w, n) AS stop, lead(start) OVER w IS NULL AS tail, row_number() OVER w AS scene FROM g WINDOW w AS (PARTITION BY u ORDER BY start))
SELECT u AS user_id, scene, first, stop - 1 AS last, round(first / 24.0, 3) AS start, round(stop / 24.0, 3) AS "end" FROM h WHERE NOT tail OR first < n - 1""")
def scene_list(spark, d):
    """Scenes of each user's events as frames: a start where the value is over 15, three frames apart at least, and a last scene."""
    rows = folds.ordered(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value")
    frames = F.transform("values", lambda v, i: F.struct(i.cast("long").alias("frame"), v.alias("diff")))
    return rows.select("user_id", F.explode(folds.scenes(frames, 15.0, 3, 24.0)).alias("s")).select("user_id", "s.scene", "s.first", "s.last", "s.start", "s.end")


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE event_id::VARCHAR END AS title,
CASE WHEN event_id % 2 = 0 THEN event_type || ',' || event_id ELSE event_type END AS tags, CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END AS n FROM events""")
def repaired_fields(spark, d):
    """Fields of a JSON object in prose that may be null, of another kind or negative."""
    k = F.col("event_id")
    title = F.when(k % 3 == 0, "null").when(k % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise(k.cast("string"))
    tags = F.when(k % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('",'), k, F.lit("]"))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    n = F.when(k % 5 == 0, F.concat(F.lit("-"), k)).when(k % 5 == 1, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.concat(k, F.lit(".5")))
    made = F.concat(F.lit('Here: {"title":'), title, F.lit(',"tags":'), tags, F.lit(',"n":'), n, F.lit("}. Done"))
    r = T.repaired(made, ["title"], ["tags"], ["n"])
    return t(spark, d, "events").select("event_id", r.alias("r")).select("event_id", "r.title", F.array_join("r.tags", ",").alias("tags"), "r.n")


@register("""WITH a AS (SELECT role AS entity, conv_id * 1000 + turn AS passage, conv_id, turn FROM conversations WHERE turn % 3 = 1),
p AS (SELECT conv_id * 1000 + turn AS near, conv_id, turn, role, text FROM conversations),
x AS (SELECT a.entity, a.passage, p.near, p.turn - a.turn AS rank FROM a JOIN p ON p.conv_id = a.conv_id AND p.turn BETWEEN a.turn - 2 AND a.turn + 2 AND p.turn <> a.turn
 UNION ALL SELECT a.entity, a.passage, p.near, 3 FROM a JOIN p ON p.role = a.entity AND p.near % 499 = 0 AND p.near <> a.passage),
m AS (SELECT entity, passage, near, min(rank) AS rank FROM x GROUP BY ALL)
SELECT entity, passage, near, row_number() OVER (PARTITION BY entity, passage ORDER BY rank, near) AS place FROM m
WHERE EXISTS (SELECT 1 FROM p WHERE p.near = m.near AND (p.role = m.entity OR p.near % 2 = 0)) QUALIFY place <= 6""")
def linked_neighbors(spark, d):
    """Turns beside every third turn that its speaker is linked to: those that are the speaker's own, and every second one of a conversation; then those told of the speaker."""
    p = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("passage"), F.col("conv_id").alias("group"), F.col("turn").alias("seq"), F.col("role").alias("entity"))
    spoken = p.where("passage % 2 = 0").select("passage", "group").join(p.select("entity", "group").distinct(), "group").select("entity", "passage")
    links = p.select("entity", "passage").unionByName(spoken)
    found = lookup.neighbor_passages(p.where("seq % 3 = 1").select("entity", "passage"), p.select("passage", "group", "seq"), links, p.where("passage % 499 = 0").select("entity", "passage"))
    return found.select("entity", "passage", "near", F.col("place").cast("long").alias("place"))


@register("""SELECT l_orderkey, l_linenumber, l_returnflag AS side, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, l_returnflag)::BIGINT AS place
FROM (SELECT DISTINCT l_orderkey, min(l_linenumber) AS l_linenumber, l_returnflag FROM lineitem GROUP BY l_orderkey, l_returnflag)""")
def ordered_sides(spark, d):
    side = F.when(F.col("l_returnflag") == "A", "first").when(F.col("l_returnflag") == "R", "last").otherwise(F.col("l_returnflag"))
    one = t(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("l_linenumber")).withColumn("side", side)
    return media.frame_order(one, "l_orderkey").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("side"), F.col("place").cast("long").alias("place"))


@register("""WITH m AS (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey) SELECT p_partkey, l_orderkey FROM part JOIN m ON l_partkey = p_partkey""")
def needed_membership(spark, d):
    """As first_membership, of the parts that were ordered; a part in no array would end the query with its name."""
    li = t(spark, d, "lineitem")
    arrays = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    parts = t(spark, d, "part").select("p_partkey").join(li.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    return lookup.first_member(parts, arrays, "p_partkey", "parts", "l_orderkey", needed=True)
