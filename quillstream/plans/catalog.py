"""Queries over the driver's tables, one or more per operator, with the same result in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds, intervals, lookup, media, records, search

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
WORDS = ["moron", "license", "released", "pathetic"]
_IN = ", ".join(f"'{w}'" for w in WORDS)


def register(sql: str | None = None):
    def wrap(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return wrap


#: Modules beside this one whose queries are registered with it.
PARTS = ("predicates", "summaries", "retrieval", "texts", "writing", "indexes", "files", "prose", "requests")


def _load() -> None:
    for name in PARTS:
        importlib.import_module("." + name, __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


# retrieval

_BM25 = f"""
tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
st AS (SELECT count(*) AS docs, avg(len(w)) AS avg_n FROM tok),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tok) WHERE term IN ({_IN}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
lex AS (SELECT doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))), 9) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)
"""
_COS = """
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 7),
sem AS (SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) AS score FROM embeddings, q)
"""


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return t(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()[0]


@register(f"""WITH {_BM25}, {_COS},
a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 40),
b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem QUALIFY rank <= 40),
f AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS rrf, count(*) AS n_modes, max(lx) AS lx, max(cs) AS cs FROM
  (SELECT id, rank, rank AS lx, NULL AS cs FROM a UNION ALL SELECT id, rank, NULL, score FROM b) GROUP BY id)
SELECT id AS doc_id, rrf, n_modes, round(least(0.98, greatest(0.05, 0.72 * greatest(0, least(1, coalesce(cs, 0))) + CASE WHEN n_modes = 2 THEN 0.14 ELSE 0 END + coalesce(0.10 / lx, 0))), 6) AS confidence
FROM f ORDER BY rrf DESC, id LIMIT 10""")
def hybrid_search(spark, d):
    lexical = search.bm25(t(spark, d, "documents"), WORDS)
    return search.hybrid(lexical, search.cosine(t(spark, d, "embeddings"), _query_vector(spark, d)), 10, 40).withColumnRenamed("id", "doc_id")


@register(f"WITH {_BM25} SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM lex QUALIFY rank <= 20")
def bm25_topk(spark, d):
    return search.top(search.bm25(t(spark, d, "documents"), WORDS), 20).select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@register(f"WITH {_COS} SELECT id AS vec_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM sem QUALIFY rank <= 20")
def cosine_topk(spark, d):
    return search.top(search.cosine(t(spark, d, "embeddings"), _query_vector(spark, d)), 20).select(F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@register(f"""WITH {_BM25}, r AS (SELECT id, score FROM lex ORDER BY score DESC, id LIMIT 40)
SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM r JOIN documents ON id = doc_id WHERE lang = 'en'""")
def postfilter_topk(spark, d):
    """The filter comes after the cut, so it may under-fill; ranks are computed anew."""
    docs = t(spark, d, "documents")
    cut = search.bm25(docs, WORDS).orderBy(F.desc("score"), "id").limit(40)
    kept = cut.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("lang = 'en'")
    return kept.select(F.col("id").alias("doc_id"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("rank"))


@register("""SELECT doc_id, round(power((contains(lower(text), 'moron'))::INT + (contains(lower(text), 'license'))::INT + (contains(lower(text), 'released'))::INT + (contains(lower(text), 'pathetic'))::INT, 2) / 4.0, 6) AS score
FROM documents ORDER BY score DESC, doc_id LIMIT 25""")
def coverage_rerank(spark, d):
    return t(spark, d, "documents").select("doc_id", search.coverage(F.col("text"), WORDS).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@register("""SELECT source, count(*) AS citations, round((sum(contains(lower(text), 'license')::INT) + 2 * sum(contains(lower(text), 'moron')::INT) + 3 * max(contains(source, '1')::INT)) / greatest(1.0, sqrt(count(*))), 6) AS score
FROM documents GROUP BY source""")
def entity_specificity_rank(spark, d):
    has = lambda c, w: F.contains(F.lower(c), F.lit(w)).cast("int")
    g = t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("citations"), F.sum(has("text", "license")).alias("s"), F.sum(has("text", "moron")).alias("e"), F.max(has("source", "1")).alias("m"))
    return g.select("source", "citations", F.round(search.specificity(F.col("s"), F.col("e"), F.col("m"), F.col("citations")), 6).alias("score"))


# time

_SPANS = "sp AS (SELECT user_id, event_id, epoch(ts) AS s, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM events)"


def _spans(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t(spark, d, "events").select("user_id", "event_id", epoch("ts").alias("s"), F.lead(epoch("ts")).over(w).alias("e"))


@register(f"""WITH {_SPANS}, hit AS (SELECT event_id, user_id, epoch(ts) AS start, epoch(ts) + 600 AS "end" FROM events WHERE event_type = 'purchase')
SELECT hit.event_id AS item_id, sp.event_id AS span_id FROM hit JOIN sp ON hit.user_id = sp.user_id AND hit."end" >= sp.s AND hit.start < sp.e WHERE sp.e IS NOT NULL""")
def interval_overlap_join(spark, d):
    items = t(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("item_id"), epoch("ts").alias("start"), (epoch("ts") + 600).alias("end"))
    spans = _spans(spark, d).where("e is not null").withColumnRenamed("event_id", "span_id")
    return intervals.overlap_join(items, spans, 86_400.0, ("user_id",)).select("item_id", "span_id")


@register("""WITH g AS (SELECT user_id, day * 86400.0 + 1704067200 AS s, day * 86400.0 + 1704067200 + 3600 AS e, day FROM (SELECT DISTINCT user_id FROM events) u, range(0, 30) r(day)),
i AS (SELECT user_id, event_id, epoch(ts) AS start, epoch(ts) + 60 AS "end" FROM events),
p AS (SELECT g.*, event_id, ("end" >= s AND start < e) AS "overlaps", greatest(s - "end", start - e, 0) AS dist FROM g JOIN i USING (user_id)),
r AS (SELECT *, max("overlaps"::INT) OVER w AS anyone, row_number() OVER (PARTITION BY user_id, day ORDER BY dist, event_id) AS rn FROM p WINDOW w AS (PARTITION BY user_id, day))
SELECT user_id, day, event_id, "overlaps" FROM r WHERE "overlaps" OR (anyone = 0 AND rn = 1)""")
def overlap_or_nearest(spark, d):
    ev = t(spark, d, "events")
    days = ev.select("user_id").distinct().withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    clips = days.withColumn("s", F.col("day") * 86400.0 + 1704067200).withColumn("e", F.col("s") + 3600)
    items = ev.select("user_id", "event_id", epoch("ts").alias("start"), (epoch("ts") + 60).alias("end"))
    return intervals.overlap_or_nearest(items, clips, ["user_id"], "event_id", ["day"], 86_400.0).select("user_id", "day", "event_id", "overlaps")


@register("""WITH l AS (SELECT *, epoch(ts) AS s, lag(event_type) OVER w AS pk, lag(epoch(ts)) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum((pk IS NULL OR pk <> event_type OR s - pe > 21600)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM l)
SELECT user_id, turn::BIGINT AS turn, min(event_type) AS event_type, min(s) AS start_s, max(s) AS end_s, count(*) AS n FROM n GROUP BY user_id, turn""")
def sessionize_turns(spark, d):
    ev = t(spark, d, "events").withColumn("s", epoch("ts"))
    out = intervals.turns(ev, ["user_id"], "event_type", "s", "s", 21_600, ["ts", "event_id"])
    return out.groupBy("user_id", "turn").agg(F.min("event_type").alias("event_type"), F.min("s").alias("start_s"), F.max("s").alias("end_s"), F.count(F.lit(1)).alias("n"))


@register("""SELECT event_id, gap FROM (SELECT event_id, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch(ts) AS gap FROM events) WHERE gap > 86400""")
def gap_detection(spark, d):
    ev = t(spark, d, "events").withColumn("s", epoch("ts"))
    return intervals.gaps(ev, ["user_id"], "s", "s", ["ts", "event_id"], 86_400).select("event_id", "gap")


@register("""WITH b AS (SELECT min(epoch(ts)) AS a, max(epoch(ts)) - min(epoch(ts)) AS dur FROM events),
c AS (SELECT a, dur, k * 780 * 60.0 AS start FROM b, range(0, 100000) r(k) WHERE k = 0 OR k * 780 * 60.0 < dur - 900 * 60.0 + 780 * 60.0)
SELECT start, least(dur, start + 54000) AS "end", (SELECT count(*) FROM events WHERE epoch(ts) - a >= start AND epoch(ts) - a < start + 54000) AS n FROM c""")
def sliding_time_chunks(spark, d):
    ev = t(spark, d, "events").select(epoch("ts").alias("x"))
    span = ev.agg(F.min("x").alias("a"), (F.max("x") - F.min("x")).alias("dur"))
    chunks = span.select("a", "dur", F.explode(intervals.chunk_starts(F.col("dur"), 54_000, 7_200)).alias("start"))
    width = 54_000.0
    points = ev.crossJoin(F.broadcast(span.select("a"))).select((F.col("x") - F.col("a")).alias("start"), (F.col("x") - F.col("a")).alias("end"))
    spans = chunks.select(F.col("start").alias("s"), (F.col("start") + width).alias("e"), F.least("dur", F.col("start") + width).alias("until"))
    hits = intervals.overlap_join(points, spans, width).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return spans.join(hits, "s", "left").select(F.col("s").alias("start"), F.col("until").alias("end"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register(f"""WITH {_SPANS} SELECT event_id, k AS piece, s + k * 43200 AS piece_start, least(e, s + (k + 1) * 43200) AS piece_end FROM (SELECT event_id, s, e, unnest(range(0, ceil((e - s) / 43200)::BIGINT))::INT AS k FROM sp WHERE e > s)""")
def subdivide_intervals(spark, d):
    return intervals.subdivide(_spans(spark, d).where("e is not null"), "s", "e", 43_200.0).select("event_id", "piece", "piece_start", "piece_end")


@register("""WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
f AS (SELECT k, i, q AS used, 0 AS bin FROM o WHERE i = 1
 UNION ALL SELECT o.k, o.i, CASE WHEN f.used > 0 AND f.used + o.q > 80 THEN o.q ELSE f.used + o.q END, f.bin + (f.used > 0 AND f.used + o.q > 80)::INT FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS l_orderkey, bin, count(*) AS n, max(used) AS used FROM f GROUP BY k, bin""")
def greedy_partition(spark, d):
    rows = folds.ordered(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_quantity")
    bins = rows.select("l_orderkey", F.explode(F.arrays_zip("values", folds.greedy_bins(F.col("values"), 80.0).alias("bins"))).alias("x"))
    return bins.groupBy("l_orderkey", F.col("x.bins").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("x.values").alias("used"))


@register("""WITH RECURSIVE o AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS i, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
f AS (SELECT 1::BIGINT AS i, 0::BIGINT AS part UNION ALL SELECT (SELECT min(n.i) FROM o n WHERE n.i > f.i AND n.p - (o.p - o.v) > 20000000), part + 1 FROM f JOIN o ON o.i = f.i WHERE (SELECT min(n.i) FROM o n WHERE n.i > f.i AND n.p - (o.p - o.v) > 20000000) IS NOT NULL)
SELECT o_orderkey, part FROM o ASOF JOIN f ON o.i >= f.i""")
def long_partition(spark, d):
    """All orders as one timeline, in greedy parts of a total of twenty million."""
    o = t(spark, d, "orders").select("o_orderkey", F.lit(1).alias("line"), epoch("o_orderdate").alias("at"), F.floor("o_totalprice").cast("long").alias("total"))
    return intervals.budget_parts(o, ["line"], "at", 30 * 86_400.0, ["at", "o_orderkey"], "total", 20_000_000).select("o_orderkey", "part")


@register(None)
def word_budget_chunks(spark, d):
    """Lines of a document as paragraphs; chunks of 60 to 90 words with one line of overlap."""
    lines = F.split("text", "\n")
    docs = t(spark, d, "documents").select("doc_id", F.transform(lines, lambda x: T.word_count(x)).alias("n"))
    return docs.select("doc_id", F.posexplode(folds.word_budget(F.col("n"), 60, 90, 1)).alias("sequence", "c"), "n").select(
        "doc_id", "sequence", "c.first", "c.last", F.aggregate(F.slice("n", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("words")
    )


@register("""WITH RECURSIVE o AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + value AS e, props AS x, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), epoch(ts) + value, props) AS i FROM events),
f(user_id, i, acc) AS (SELECT user_id, 0, []::STRUCT(s DOUBLE, e DOUBLE, x VARCHAR)[] FROM o WHERE i = 1
 UNION ALL SELECT o.user_id, o.i, CASE WHEN list_position(list_transform(acc, lambda a: abs(a.s - o.s) <= 3600 AND abs(a.e - o.e) <= 3600), true) IS NULL OR list_position(list_transform(acc, lambda a: abs(a.s - o.s) <= 3600 AND abs(a.e - o.e) <= 3600), true) = 0 THEN list_append(acc, {'s': o.s, 'e': o.e, 'x': o.x})
  ELSE list_transform(acc, lambda a, k: CASE WHEN k = list_position(list_transform(acc, lambda b: abs(b.s - o.s) <= 3600 AND abs(b.e - o.e) <= 3600), true) AND length(o.x) > length(a.x) THEN {'s': o.s, 'e': o.e, 'x': o.x} ELSE a END) END
 FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1),
l AS (SELECT user_id, acc FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1)
SELECT user_id, u.s AS start_s, u.e AS end_s, u.x AS props FROM (SELECT user_id, unnest(acc) AS u FROM l)""")
def reconcile_tolerance(spark, d):
    """Events of a user within an hour of start and of end are one; the longer props text stays. Timelines are cut at longer pauses."""
    ev = t(spark, d, "events").select("user_id", epoch("ts").alias("start"), (epoch("ts") + F.col("value")).alias("end"), F.col("props").alias("sentence"))
    out = intervals.reconciled(ev, ["user_id"], 3600.0, 3600.0, 86_400.0)
    return out.select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.col("sentence").alias("props"))


# records

@register("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def chronological_first(spark, d):
    return records.pick(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@register("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def first_occurrence_dedupe(spark, d):
    return t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT -o_orderkey, 'N', o_totalprice FROM orders WHERE o_orderkey % 1000 = 1""")
def upsert_last_wins(spark, d):
    base = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changes = base.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("X")).unionByName(base.where("o_orderkey % 1000 = 1").withColumn("o_orderkey", -F.col("o_orderkey")).withColumn("o_orderstatus", F.lit("N")))
    return records.upsert(base, changes, ["o_orderkey"])


@register("""SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END) AS quantity FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS l_quantity FROM lineitem UNION SELECT DISTINCT l_orderkey, 1, 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)) GROUP BY l_orderkey""")
def nested_upsert(spark, d):
    slots = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"))
    nested = slots.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("k"), "q")).alias("items"))
    out = records.nested_upsert(F.col("items"), F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("q")), "k")
    return nested.select("l_orderkey", F.size(out).cast("long").alias("n"), F.aggregate(out, F.lit(0.0), lambda s, x: s + x["q"]).alias("quantity"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority, o_orderkey % 11 = 0 AS changed FROM orders""")
def snapshot_diff(spark, d):
    now = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    before = now.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
    return records.diff(now, before, ["o_orderkey"], "o_orderstatus", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority", "changed")


@register("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_anti(spark, d):
    return records.pending(t(spark, d, "documents").select("doc_id"), t(spark, d, "labels").where("quality = 1"), ["doc_id"])


@register("SELECT o_orderkey, s::INT AS slot FROM orders, range(1, 8) r(s) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = s)")
def slot_backfill(spark, d):
    slots = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("slot"))
    return records.backfill(t(spark, d, "orders"), slots, "o_orderkey", "slot", 7)


@register("""WITH b AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1),
c AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS done FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber AS best_slot, l_extendedprice AS best, total, done, total = done AS complete FROM b JOIN c USING (l_orderkey)""")
def best_slot_per_frame(spark, d):
    li = t(spark, d, "lineitem")
    best = F.struct(F.col("l_extendedprice").alias("p"), (-F.col("l_linenumber")).alias("n"))
    g = li.groupBy("l_orderkey").agg(F.max(best).alias("x"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("done"))
    return g.select("l_orderkey", (-F.col("x.n")).alias("best_slot"), F.col("x.p").alias("best"), "total", "done", (F.col("total") == F.col("done")).alias("complete"))


@register("""SELECT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def array_membership(spark, d):
    """Entries of every order's array of parts, for finished orders: the arrays are unfolded after orders were chosen."""
    arrays = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    kept = arrays.join(t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return kept.select("l_orderkey", F.explode("parts").alias("l_partkey"))


@register("""WITH m AS (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey) SELECT p_partkey, l_orderkey FROM part LEFT JOIN m ON l_partkey = p_partkey""")
def first_membership(spark, d):
    """Of the arrays that hold an entry the first in order; null where none does."""
    arrays = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return lookup.first_member(t(spark, d, "part").select("p_partkey"), arrays, "p_partkey", "parts", "l_orderkey")


@register("""SELECT a.conv_id, a.turn, b.turn AS near_turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn + 2 AND b.turn <> a.turn WHERE a.role = 'user'""")
def neighbor_offset(spark, d):
    """Offsets are made explicit, so the join stays an equi-join on (conversation, turn)."""
    c = t(spark, d, "conversations")
    wanted = c.where("role = 'user'").select("conv_id", "turn", F.explode(F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])).alias("k")).withColumn("near_turn", F.col("turn") + F.col("k"))
    return wanted.join(c.select("conv_id", F.col("turn").alias("near_turn")), ["conv_id", "near_turn"]).select("conv_id", "turn", "near_turn")


# entities

@register("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
r(node, c) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def connected_components(spark, d):
    """Vectors are connected by all pairs with a cosine of 0.3 or more, whatever their labels."""
    return records.connected(search.linking_pairs(t(spark, d, "embeddings"), "vec_id", "embedding", 0.3))


@register("""WITH s AS (SELECT c_nationkey, c_mktsegment AS name, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, name, n FROM s QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, length(name) DESC, name DESC) = 1""")
def spelling_vote(spark, d):
    c = t(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    best = c.groupBy("c_nationkey").agg(F.max(F.struct("n", F.length("name").alias("l"), "name")).alias("x"))
    return best.select("c_nationkey", "x.name", "x.n")


@register("""WITH a AS (SELECT n_nationkey, unnest([lower(n_name), lower(left(n_name, 3)) || '.']) AS alias, n_name FROM nation), k AS (SELECT trim(regexp_replace(alias, '[^a-z0-9]+', ' ', 'g')) AS key, min(n_name) AS canonical FROM a GROUP BY 1)
SELECT n_nationkey, coalesce(canonical, n_name) AS canonical FROM nation LEFT JOIN k ON key = trim(regexp_replace(lower(left(n_name, 3)), '[^a-z0-9]+', ' ', 'g'))""")
def alias_resolution(spark, d):
    n = t(spark, d, "nation")
    aliases = n.select("n_name", F.explode(F.array(F.lower("n_name"), F.concat(F.lower(F.left("n_name", F.lit(3))), F.lit(".")))).alias("a"))
    keys = aliases.groupBy(T.norm_key(F.col("a")).alias("key")).agg(F.min("n_name").alias("canonical"))
    return n.withColumn("key", T.norm_key(F.left("n_name", F.lit(3)))).join(keys, "key", "left").select("n_nationkey", F.coalesce("canonical", "n_name").alias("canonical"))


@register("""SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderpriority IS NOT NULL)), ',') AS priorities
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey WHERE contains(lower(n_name), 'a') GROUP BY r_name, n_name""")
def graph_dossier(spark, d):
    n = t(spark, d, "nation").where(F.contains(F.lower("n_name"), F.lit("a")))
    j = t(spark, d, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(t(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("r_name", "n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))


# text and ids

@register("""SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', '', 'g')) AS dedup_key, 'part:' || left(sha256(p_name || chr(31) || p_partkey), 24) AS digest FROM part""")
def slug_and_digest_ids(spark, d):
    name = F.col("p_name")
    return t(spark, d, "part").select("p_partkey", T.slug(name).alias("slug"), T.dedup_key(name).alias("dedup_key"), T.digest_id("part", name, F.col("p_partkey")).alias("digest"))


@register("""WITH m AS (SELECT event_id, (round_even(value * 1000 * 37, 0))::BIGINT AS ms FROM events)
SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code, round(ms / 1000.0, 3) AS seconds FROM m""")
def timecodes(spark, d):
    e = t(spark, d, "events").select("event_id", T.timecode(F.col("value") * 37).alias("code"))
    return e.select("event_id", "code", F.round(T.parse_timecode(F.col("code")), 3).alias("seconds"))


@register("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, json_extract_string(props, '$.missing') IS NULL AS repaired FROM events""")
def json_repair(spark, d):
    parsed = F.from_json(T.json_slice(F.concat(F.lit("Result: "), F.col("props"), F.lit(" done"))), "k long, missing string")
    return t(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.lit(0)).alias("k"), parsed["missing"].isNull().alias("repaired"))


@register(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) AS n_sentences FROM documents""")
def sentence_split(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@register("""SELECT o_orderkey, CASE WHEN regexp_matches(p, '(?i)^\\s*(not[\\s-]specified|unspecified|unknown|none|n/?a)\\b') THEN '' ELSE p END AS priority FROM (SELECT o_orderkey, regexp_replace(o_orderpriority, '^\\d-', '') AS p FROM orders)""".replace("\\\\", "\\"))
def trait_normalize(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.trait(F.regexp_replace("o_orderpriority", r"^\d-", "")).alias("priority"))


@register("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'metal' WHEN contains(lower(p_type), 'brass') THEN 'metal' WHEN contains(lower(p_name), 'blue') THEN 'colour' ELSE 'other' END AS kind FROM part""")
def keyword_classify(spark, d):
    has = lambda c, w: F.contains(F.lower(c), F.lit(w))
    return t(spark, d, "part").select("p_partkey", F.when(has("p_type", "steel") | has("p_type", "brass"), "metal").when(has("p_name", "blue"), "colour").otherwise("other").alias("kind"))


# summaries and gates

@register("""SELECT CASE WHEN l_quantity < 2 THEN '<2' WHEN l_quantity < 5 THEN '2-5' WHEN l_quantity < 10 THEN '5-10' WHEN l_quantity < 30 THEN '10-30' ELSE '>30' END AS bucket, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1""")
def duration_histogram(spark, d):
    q = F.col("l_quantity")
    bucket = F.when(q < 2, "<2").when(q < 5, "2-5").when(q < 10, "5-10").when(q < 30, "10-30").otherwise(">30")
    g = t(spark, d, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bucket", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


@register("""SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS slots FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_linenumber)""")
def uniqueness_gate(spark, d):
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("slots"))
    return g.where("n <> slots")


@register("""SELECT source, count(DISTINCT d.doc_id) AS total, count(DISTINCT l.doc_id) AS labelled, count(DISTINCT d.doc_id) = count(DISTINCT l.doc_id) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""")
def completeness_gate(spark, d):
    j = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id", F.lit(True).alias("there")).distinct(), "doc_id", "left")
    g = j.groupBy("source").agg(F.count_distinct("doc_id").alias("total"), F.count_distinct(F.when(F.col("there"), F.col("doc_id"))).alias("labelled"))
    return g.withColumn("complete", F.col("total") == F.col("labelled"))


@register("""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def evidence_substring(spark, d):
    """Every quote in every text that contains it: texts go once through an automaton of the quotes."""
    b = t(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    return lookup.contains_join(b, t(spark, d, "documents"), "quote", "text", keep=["doc_id"]).select("item_id", "doc_id")


@register("""(SELECT o_orderkey, o_totalprice, 'top' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, o_totalprice, 'bottom' FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5)""")
def topk_long_short(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).withColumn("side", F.lit("top")).unionByName(o.orderBy("o_totalprice", "o_orderkey").limit(5).withColumn("side", F.lit("bottom")))


@register("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus""")
def status_counts(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@register("""SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events""")
def running_best(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, d, "events").select("event_id", F.max("value").over(so_far).alias("best"), F.coalesce(F.col("value") > F.max("value").over(before), F.lit(True)).alias("improved"))


@register("SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Part', count(*) FROM part")
def label_counts(spark, d):
    out = None
    for label in ("Region", "Nation", "Customer", "Part"):
        one = t(spark, d, label.lower()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# scenes, frames, citations


@register("""WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
g AS (SELECT k, greatest(1, floor(sum(q) / 3))::BIGINT AS target FROM o GROUP BY k),
f AS (SELECT k, i, q AS words, 0 AS chunk FROM o WHERE i = 1
 UNION ALL SELECT o.k, o.i, CASE WHEN f.words + o.q > target AND f.chunk < 2 THEN o.q ELSE f.words + o.q END, f.chunk + (f.words + o.q > target AND f.chunk < 2)::INT FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1 JOIN g ON g.k = f.k)
SELECT k AS l_orderkey, chunk, count(*) AS n FROM f GROUP BY k, chunk""")
def repair_split(spark, d):
    lines = t(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    rows = folds.ordered(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "q")
    return rows.select("l_orderkey", F.explode(media.repair_split(F.col("values"), 3)).alias("chunk")).groupBy("l_orderkey", "chunk").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH c AS (SELECT conv_id, role, turn, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS sentence, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]*'), 1) AS pos FROM conversations),
r AS (SELECT conv_id, role, sentence, len(list_filter(regexp_split_to_array(sentence, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) AS words, length(sentence) AS chars, turn, pos FROM c)
SELECT conv_id, role, sentence, words, chars, turn FROM r QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY words DESC, chars DESC, turn, pos, sentence) = 1""")
def representative_sentence(spark, d):
    c = t(spark, d, "conversations")
    out = media.representative_sentence(c, ["conv_id", "role"], ["turn"], F.regexp_extract_all("text", F.lit(r"([^.!?]+[.!?]*)"), 1))
    return out.select("conv_id", "role", "sentence", F.col("words").cast("long").alias("words"), F.col("chars").cast("long").alias("chars"), "turn")


@register("""SELECT source, doc_id::VARCHAR AS passage, coalesce(n_chars, 999) AS chapter FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 1 ELSE 2 END, coalesce(n_chars, 999), doc_id::VARCHAR) = 1""")
def first_place(spark, d):
    return media.first_place(t(spark, d, "documents"), ["source"], "lang", "en", "n_chars", "doc_id")


def _dashboard(spark, d):
    scenes = t(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey")).alias("first_file"), F.when(F.col("p_size") > 10, F.concat(F.lit("l"), F.col("p_partkey"))).otherwise("").alias("last_file"))
    made = t(spark, d, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 1, "f").otherwise("l"), F.col("l_partkey")).alias("file"), F.when(F.col("l_returnflag") != "R", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey")).alias("image"), F.col("l_discount").alias("score"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("place"))
    return media.dashboard_frames(scenes, made, "p_partkey", "place")


_FRAMES = """
fr AS (SELECT p_partkey, 'first' AS side, 'f' || p_partkey AS file FROM part UNION ALL SELECT p_partkey, 'last', 'l' || p_partkey FROM part WHERE p_size > 10),
ge AS (SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'f' ELSE 'l' END || l_partkey AS file, l_returnflag <> 'R' AS done, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS image, l_discount AS score, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem),
pe AS (SELECT file, count(*) AS generations, count(*) FILTER (done) AS completed, max(score) FILTER (done) AS best_score FROM ge GROUP BY file),
be AS (SELECT file, image FROM ge WHERE done QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, place) = 1),
da AS (SELECT p_partkey, side, fr.file, coalesce(generations, 0) AS generations, coalesce(completed, 0) AS completed, best_score, coalesce(image, fr.file) AS shown FROM fr LEFT JOIN pe USING (file) LEFT JOIN be USING (file))
"""


@register(f"WITH {_FRAMES} SELECT * FROM da")
def dashboard_frames(spark, d):
    return _dashboard(spark, d)


@register(f"WITH {_FRAMES} SELECT count(*) AS frames, count(*) FILTER (completed > 0) AS frames_done, sum(completed)::BIGINT AS completed, count(*) FILTER (completed = 0) AS frames_open FROM da")
def dashboard_stats(spark, d):
    return media.dashboard_stats(_dashboard(spark, d))
