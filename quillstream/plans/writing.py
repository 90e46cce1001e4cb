"""Queries of changes to keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ivf
from ..operators import mutate as M
from ..sources import jsonl, versioned
from .catalog import register, t


@register("""WITH s AS (SELECT l_orderkey, l_linenumber AS k, min(l_quantity) AS q, max(l_tax) AS x FROM lineitem GROUP BY ALL), h AS (SELECT DISTINCT l_orderkey FROM lineitem)
SELECT l_orderkey, k, CASE WHEN k = 1 THEN 0.0 ELSE q END AS q, x FROM s UNION ALL SELECT l_orderkey, 1, 0.0, NULL FROM h WHERE l_orderkey NOT IN (SELECT l_orderkey FROM s WHERE k = 1)""")
def merged_nested(spark, d):
    """The entry of equal key keeps the fields that the new one leaves open."""
    s = t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg(F.min("l_quantity").alias("q"), F.max("l_tax").alias("x"))
    n = s.groupBy("l_orderkey").agg(F.collect_list(F.struct("k", "q", "x")).alias("items"))
    item = F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("q"), F.lit(None).cast("double").alias("x"))
    return n.select("l_orderkey", F.explode(M.merge_nested(F.col("items"), item, "k", ["k", "q", "x"])).alias("e")).select("l_orderkey", "e.*")


@register("SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'text' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def union_first_wins(spark, d):
    a = t(spark, d, "labels").select("doc_id", F.lit("label").alias("origin"))
    return M.union_first(a, t(spark, d, "documents").select("doc_id", F.lit("text").alias("origin")), ["doc_id"])


@register("SELECT p_partkey, NULL::VARCHAR AS p_brand, NULL::DOUBLE AS score FROM part")
def null_columns(spark, d):
    return M.set_columns(t(spark, d, "part").select("p_partkey", "p_brand"), {"p_brand": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})


@register("SELECT p_partkey, '' AS p_brand, NULL::INTEGER AS p_size, p_name FROM part")
def cleared_columns(spark, d):
    return M.clear_columns(t(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name"), ["p_brand", "p_size", "nowhere"])


@register("""WITH s AS (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'changed' ELSE l_returnflag END AS flag FROM lineitem)
SELECT 'scene' AS kind, * FROM s UNION ALL SELECT 'copy', * FROM s""")
def both_copies(spark, d):
    """Standalone rows and the copies within arrays change together."""
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_returnflag").alias("flag"))
    chapters = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "flag")).alias("scenes"))
    changes = t(spark, d, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("l_partkey"), F.lit("changed").alias("flag"))
    own, whole = M.update_both(li, chapters, changes, "l_partkey", "scenes", ["flag"])
    copies = whole.select("l_orderkey", F.explode("scenes").alias("s")).select(F.lit("copy").alias("kind"), "l_orderkey", "s.*")
    return own.select(F.lit("scene").alias("kind"), "l_orderkey", "l_partkey", "flag").unionByName(copies)


@register("""SELECT doc_id, 'now' AS origin, quality FROM labels UNION ALL SELECT DISTINCT doc_id, 'before', -1 FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def imported_results(spark, d):
    now = t(spark, d, "labels").select("doc_id", F.lit("now").alias("origin"), "quality")
    return M.import_results(now, t(spark, d, "documents"), ["doc_id"], F.col("lang") == "de", {"origin": F.lit("before"), "quality": F.lit(-1)}, ["text", "source"])


@register("""WITH f AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1)
SELECT f.l_orderkey, s::INT AS l_linenumber, f.l_partkey, 'slot ' || s AS note FROM f, range(1, 8) r(s) WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = f.l_orderkey AND x.l_linenumber = s)""")
def template_slots(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("").alias("note"))
    made = M.from_template(li, ["l_orderkey"], "l_linenumber", 7, ["l_linenumber", "l_partkey", "l_suppkey"], {"note": F.concat(F.lit("slot "), "l_linenumber")})
    return made.drop("l_suppkey")


@register("SELECT o_orderkey, 'kept' AS origin FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT c_custkey, 'fresh' FROM customer WHERE c_acctbal < 0")
def rebuilt_rows(spark, d):
    table = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("kept").alias("origin"))
    fresh = t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_orderkey"), F.lit("fresh").alias("origin"))
    return M.rebuild(table, F.col("o_orderstatus") == "F", fresh).select("o_orderkey", "origin")


@register("SELECT n_nationkey, n_name, CASE WHEN n_name = 'NATION_3' THEN 'Third' ELSE lower(n_name) END AS shown FROM nation WHERE n_name <> 'NATION_9'")
def overridden_names(spark, d):
    return M.override(t(spark, d, "nation").select("n_nationkey", "n_name", F.lower("n_name").alias("shown")), "n_name", "shown", {"NATION_3": "Third"}, ["NATION_9"])


@register("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT -1 - c_custkey % 4, 'extra' FROM customer WHERE c_custkey < 8 GROUP BY 1")
def injected_rows(spark, d):
    extra = t(spark, d, "customer").where("c_custkey < 8").select((-1 - F.col("c_custkey") % 4).alias("s_suppkey"), F.lit("extra").alias("s_name"))
    more = extra.unionByName(t(spark, d, "supplier").select("s_suppkey", F.lit("twice").alias("s_name")))
    return M.inject(t(spark, d, "supplier").select("s_suppkey", "s_name"), more, ["s_suppkey"], F.col("s_name") != "", ["s_name"])


@register("""SELECT conv_id, turn FROM (SELECT *, CASE WHEN role = 'user' THEN '?' || conv_id ELSE role END AS target FROM conversations) QUALIFY row_number() OVER (PARTITION BY target ORDER BY conv_id, turn) = 1""")
def distinct_targets(spark, d):
    """Unknown names stay apart, by where they come from."""
    return M.distinct_targets(t(spark, d, "conversations"), "role", "conv_id", ["conv_id", "turn"], ["user"]).select("conv_id", "turn")


@register("""WITH n AS (SELECT l_returnflag AS namespace, l_partkey % 50 AS key, l_linenumber AS version, 'new ' || l_orderkey || '/' || l_suppkey AS value FROM lineitem WHERE l_orderkey >= 100 QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_partkey % 50, l_linenumber ORDER BY l_orderkey DESC, l_suppkey DESC, l_partkey DESC) = 1),
o AS (SELECT DISTINCT l_returnflag AS namespace, l_partkey % 50 AS key, l_linenumber AS version FROM lineitem WHERE l_orderkey < 100)
SELECT * FROM n UNION ALL SELECT *, 'old' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.namespace = o.namespace AND n.key = o.key AND n.version = o.version)""")
def key_value_put(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("namespace"), (F.col("l_partkey") % 50).alias("key"), F.col("l_linenumber").alias("version"), "l_orderkey", "l_suppkey", "l_partkey")
    store = li.where("l_orderkey < 100").select("namespace", "key", "version", F.lit("old").alias("value")).distinct()
    entries = li.where("l_orderkey >= 100").withColumn("value", F.concat(F.lit("new "), "l_orderkey", F.lit("/"), "l_suppkey"))
    return M.put(store, entries, ["l_orderkey", "l_suppkey", "l_partkey"])


@register("""SELECT 'node' AS kind, c_custkey AS a, NULL::BIGINT AS b, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE c_name END AS name FROM customer
UNION ALL SELECT 'edge', src, dst, NULL FROM (SELECT DISTINCT o_custkey AS src, o_custkey + 1 AS dst FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey + 1 IN (SELECT c_custkey FROM customer))""")
def graph_merge(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    e = t(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.lit("next").alias("kind"))
    nodes, edges = M.merge_graph(c, e.limit(0), c.where("id % 2 = 0").withColumn("name", F.lit("even")), e)
    none = lambda kind: F.lit(None).cast(kind)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), none("long").alias("b"), "name").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), none("string").alias("name")))


@register("""WITH RECURSIVE s AS (SELECT c_custkey % 60 AS main, unnest([c_custkey % 60, c_custkey % 60 // 3 + 100]) AS key, c_custkey FROM customer),
e AS (SELECT DISTINCT main AS a, key AS b FROM s WHERE main <> key), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT DISTINCT key, key FROM s UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.node)
SELECT 'n' || node AS key, CASE WHEN min('n' || c) = 'n0' THEN 'Zero' ELSE 'N' || max(c) END AS canonical FROM r GROUP BY node""")
def alias_components(spark, d):
    """Three names share an alias; the alias is said most often, but in one component a spelling is forced."""
    k = F.col("c_custkey") % 60
    rows = t(spark, d, "customer").select(F.concat(F.lit("N"), k).alias("name"), F.array(F.concat(F.lit("N"), F.floor(k / 3) + 100)).alias("aliases"))
    return M.alias_components(rows, "name", "aliases", T.norm_key, {"n0": "Zero"})


@register("""SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 END AS rung FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 OR event_id % 5 = 0""")
def retry_ladder(spark, d):
    rung = lambda n, k: lambda df: df.where(F.col("event_id") % k == 0).withColumn("rung", F.lit(n))
    return M.ladder(t(spark, d, "events").select("event_id", "event_type"), ["event_id"], [rung(1, 2), rung(2, 3), rung(3, 5)])


@register("SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def retryable_errors(spark, d):
    status = F.when(F.col("event_type") == "error", "HTTP 503 Unavailable").when(F.col("event_type") == "click", "error: TIMEOUT").when(F.col("event_type") == "view", "success after timeout").otherwise("bad request")
    return t(spark, d, "events").where(M.retryable(status, ["503", "timeout"])).select("event_id")


@register("""WITH u AS (SELECT o_orderkey, 0 AS at_, 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 1, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 2, 'o_custkey', o_custkey::VARCHAR FROM orders)
SELECT value, "column", o_orderkey FROM u QUALIFY row_number() OVER (PARTITION BY value ORDER BY o_orderkey, at_) = 1""")
def first_frames(spark, d):
    return M.first_named(t(spark, d, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], ["o_orderkey"])


@register("""WITH b AS (SELECT * FROM lineitem WHERE l_linenumber BETWEEN 1 AND 10 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_returnflag = 'R') DESC, l_partkey, l_suppkey) = 1)
SELECT k.l_orderkey, s::INT AS l_linenumber, l_partkey, l_returnflag FROM (SELECT DISTINCT l_orderkey FROM lineitem) k CROSS JOIN range(1, 11) r(s) LEFT JOIN b ON b.l_orderkey = k.l_orderkey AND b.l_linenumber = s""")
def slot_table(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return M.slots(li, "l_orderkey", "l_linenumber", 10, F.col("l_returnflag") == "R", ["l_partkey", "l_suppkey"]).drop("l_suppkey")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'merged' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def stored_merge(spark, d):
    """A stored table of every second order, into which a change of every third is merged; read again."""
    o, path = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), ivf.index_path(spark, "table")
    versioned.replace(o.where("o_orderkey % 2 = 0"), path, "o_orderkey")
    versioned.merge(o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("merged")), path, "o_orderkey")
    return versioned.read(spark, path)


@register("""SELECT '{"conv_id":' || conv_id || ',"turn":' || turn AS line FROM conversations WHERE turn % 3 = 0""")
def malformed_lines(spark, d):
    """Turns as JSON Lines, of which every third has no end; the scan tells those."""
    path, line = ivf.index_path(spark, "lines"), F.to_json(F.struct("conv_id", "turn"))
    t(spark, d, "conversations").select(F.when(F.col("turn") % 3 == 0, F.expr("left({0}, length({0}) - 1)".format("to_json(struct(conv_id, turn))"))).otherwise(line).alias("value")).write.text(path)
    return jsonl.located_errors(spark, path, "conv_id long, turn long").select(F.col("_bad").alias("line"))
