"""Queries of aggregates, orders and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import summaries as S
from .catalog import epoch, register, t


@register("SELECT o_custkey, o_orderstatus, count(*) AS mention_count FROM orders GROUP BY ALL")
def mention_counts(spark, d):
    return S.mention_counts(t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@register("""SELECT l_orderkey, first(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_returnflag <> 'N') AS flag, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS states,
array_to_string(list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS suppliers FROM lineitem GROUP BY l_orderkey""")
def catalog_export(spark, d):
    """First value that there is, sorted sets, and lists in order, of each key."""
    li = t(spark, d, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    out = S.export(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["flag"], {"states": "l_linestatus"}, {"suppliers": "l_suppkey"})
    return out.select("l_orderkey", "flag", F.array_join("states", ",").alias("states"), F.array_join("suppliers", ",").alias("suppliers"))


@register("""WITH p AS (SELECT o_custkey, o_orderpriority AS place, min(o_orderkey) AS first FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(place || '=' || first, ';' ORDER BY place) AS places FROM p GROUP BY o_custkey""")
def distinct_places(spark, d):
    out = S.distinct_places(t(spark, d, "orders"), ["o_custkey"], "o_orderpriority", ["o_orderkey"])
    return out.select("o_custkey", F.array_join(F.transform("places", lambda x: F.concat(x["place"], F.lit("="), x["o_orderkey"])), ";").alias("places"))


@register("""WITH p AS (SELECT l_orderkey, l_linenumber, string_agg(l_partkey || '/' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey) AS items FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_linenumber || ':' || items, ' ' ORDER BY l_linenumber) AS shown FROM p GROUP BY l_orderkey""")
def nested_groups(spark, d):
    out = S.nested(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey", "l_suppkey"], [])
    item = lambda x: F.concat(x["l_partkey"], F.lit("/"), x["l_suppkey"])
    return out.select("l_orderkey", F.array_join(F.transform("groups", lambda g: F.concat(g["l_linenumber"], F.lit(":"), F.array_join(F.transform(g["items"], item), ","))), " ").alias("shown"))


@register("SELECT count(*) AS records, sum(n)::BIGINT AS images FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_orderkey)")
def nested_image_count(spark, d):
    image = F.when(F.col("l_returnflag") == "R", " ").otherwise(F.col("l_returnflag"))
    arrays = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(image.alias("url"))).alias("images"))
    return arrays.agg(F.count(F.lit(1)).alias("records"), F.sum(S.count_filled(F.col("images"), "url")).alias("images"))


@register("SELECT count(*) FILTER (done) AS completed, count(*) AS total FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS done FROM lineitem GROUP BY l_orderkey)")
def completed_total(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return g.agg(F.count_if(F.exists("flags", lambda f: f == "R")).alias("completed"), F.count(F.lit(1)).alias("total"))


@register("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_quantity) * 24)::BIGINT AS frames FROM lineitem GROUP BY l_returnflag")
def duration_stats(spark, d):
    q = F.col("l_quantity")
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("least"), F.max(q).alias("most"), F.round(F.avg(q) * 24).cast("long").alias("frames"))


@register("SELECT source, round(avg(quality), 6) AS mean, count(quality) AS scored FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def mean_score(spark, d):
    """Rows without a score don't count."""
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("mean"), F.count("quality").alias("scored"))


@register("SELECT l_partkey AS id, count(*) AS frequency FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_partkey")
def hit_frequency(spark, d):
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.frequencies(t(spark, d, "lineitem").join(urgent, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("ids")), "ids")


@register("SELECT conv_id, string_agg(trim(text), ' ' ORDER BY turn, role) FILTER (trim(text) <> '') AS text FROM conversations GROUP BY conv_id HAVING count(*) FILTER (trim(text) <> '') > 0")
def joined_turns(spark, d):
    return S.joined_text(t(spark, d, "conversations"), ["conv_id"], ["turn", "role"], "text").where("text <> ''")


@register("SELECT l_orderkey, round(max(0.6 * coalesce(l_quantity, 0) + 40 * l_discount + 20 * l_tax), 6) AS best FROM lineitem GROUP BY l_orderkey")
def weighted_objective(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.max(S.objective({"l_quantity": 0.6, "l_discount": 40.0, "l_tax": 20.0})), 6).alias("best"))


def _violations(spark, d):
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    return S.violations({
        "orphan": li.select("l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").distinct(),
        "no lines": o.select("o_orderkey").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "negative": t(spark, d, "customer").where("c_acctbal < -900").select("c_custkey"),
    })


_VIOLATIONS = """SELECT DISTINCT 'orphan' AS rule, l_orderkey::VARCHAR AS item FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'no lines', o_orderkey::VARCHAR FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'negative', c_custkey::VARCHAR FROM customer WHERE c_acctbal < -900"""


@register(_VIOLATIONS)
def violation_list(spark, d):
    return _violations(spark, d)


@register(f"SELECT count(*) AS n_errors, count(*) = 0 AS valid FROM ({_VIOLATIONS})")
def validity_flag(spark, d):
    return S.verdict(_violations(spark, d))


@register("SELECT user_id, greatest(1, round_even(sum(length(props)) * 8 / (max(epoch(ts)) - min(epoch(ts))), 0)::BIGINT) AS bitrate FROM events GROUP BY user_id HAVING max(ts) > min(ts)")
def bitrate(spark, d):
    ts = epoch("ts")
    g = t(spark, d, "events").groupBy("user_id").agg(F.sum(F.length("props")).alias("size"), (F.max(ts) - F.min(ts)).alias("s"))
    return g.where("s > 0").select("user_id", S.bitrate(F.col("size"), F.col("s")).alias("bitrate"))


@register("SELECT l_orderkey, i AS ordinal, 'part ' || i AS label FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), range(1, 30) r(i) WHERE i <= n")
def default_labels(spark, d):
    """Places within an array, from 1, name what has no name."""
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return g.select("l_orderkey", F.posexplode("parts").alias("pos", "p")).select("l_orderkey", (F.col("pos") + 1).cast("long").alias("ordinal"), F.concat(F.lit("part "), F.col("pos") + 1).alias("label"))


@register("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def sequence_numbers(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("number"))


@register("SELECT doc_id, substr(text, greatest(instr(text, ' the ') - 30, 1), instr(text, ' the ') + 35 - greatest(instr(text, ' the ') - 30, 1)) AS window FROM documents WHERE instr(text, ' the ') > 0")
def character_window(spark, d):
    return t(spark, d, "documents").select("doc_id", S.around(F.col("text"), " the ", 30).alias("window")).where("window is not null")


@register("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT *, list_position(w, 'und') AS at_ FROM w)
SELECT doc_id, array_to_string(w[greatest(at_ - 3, 1):at_ + 3], ' ') AS window FROM p WHERE at_ > 0""")
def word_window(spark, d):
    return t(spark, d, "documents").select("doc_id", S.words_around(F.split("text", " "), "und", 3).alias("window")).where("window is not null")


@register("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn DESC) AS n FROM conversations) WHERE turn = 0 OR n <= 2")
def recent_turns(spark, d):
    return S.last_turns(t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 2, F.col("turn") == 0)


@register("SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_name, p_partkey) AS place FROM part QUALIFY place <= 50")
def caseless_order(spark, d):
    from pyspark.sql import Window

    best = t(spark, d, "part").orderBy(F.lower("p_name"), "p_name", "p_partkey").limit(50)
    return best.select("p_partkey", F.row_number().over(Window.orderBy(F.lower("p_name"), "p_name", "p_partkey")).cast("long").alias("place"))


@register("SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 12")
def topk_tuple(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_orderpriority"), F.desc("o_totalprice"), "o_orderkey").limit(12).select("o_orderkey")


@register("""SELECT doc_id FROM (SELECT d.doc_id, quality, toxic, lang, n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
ORDER BY coalesce(quality, 99), coalesce(toxic, 999), coalesce(n_chars, 9999), coalesce(lang, ''), doc_id LIMIT 40""")
def sentinel_sort(spark, d):
    j = t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(t(spark, d, "labels"), "doc_id", "left")
    return j.orderBy(*S.sentinel_order({"quality": 99, "toxic": 999, "n_chars": 9999, "lang": "", "doc_id": 0})).limit(40).select("doc_id")


@register("SELECT doc_id FROM documents ORDER BY contains(text, 'license') DESC, doc_id LIMIT 30")
def flag_first(spark, d):
    return t(spark, d, "documents").orderBy(F.contains("text", F.lit("license")).desc(), "doc_id").limit(30).select("doc_id")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def limited_pending(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels"), "doc_id", "left_anti").orderBy("doc_id").limit(25)


@register("""SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_orderkey = 77) ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def cursor_offset(spark, d):
    return S.after(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "o_orderkey", 77, 20).select("o_orderkey")


@register("SELECT event_id FROM events WHERE event_id >= 50 ORDER BY event_id LIMIT 15")
def start_slice(spark, d):
    return t(spark, d, "events").where("event_id >= 50").orderBy("event_id").limit(15).select("event_id")


@register("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem QUALIFY rank <= 2")
def topk_per_group(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return S.top_per(li, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], 2).drop("l_extendedprice").withColumn("rank", F.col("rank").cast("long"))


@register("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT x)), ',') AS names FROM (SELECT o_custkey, unnest([o_orderstatus, o_orderpriority]) AS x FROM orders) GROUP BY o_custkey""")
def set_union(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"), F.collect_set("o_orderpriority").alias("b"))
    return g.select("o_custkey", F.array_join(S.union_arrays([F.col("a"), F.col("b"), F.lit(None).cast("array<string>")]), ",").alias("names"))


@register("SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS inside FROM orders GROUP BY o_custkey")
def subset_test(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"))
    return g.select("o_custkey", S.subset(F.col("a"), F.array(F.lit("F"), F.lit("O"))).alias("inside"))


@register("SELECT doc_id, length(text) AS n FROM documents WHERE contains(lower(text), 'license') AND length(text) > 100")
def steps_in_turn(spark, d):
    long = lambda df: df.where(F.length("text") > 100)
    return S.apply_all(t(spark, d, "documents"), [lambda df: df.where(F.contains(F.lower("text"), F.lit("license"))), long]).select("doc_id", F.length("text").cast("long").alias("n"))
