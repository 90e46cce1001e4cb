"""Queries from a question to hydrated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, search
from .catalog import _BM25, WORDS, register, t


def _lexical(spark, d):
    return search.bm25(t(spark, d, "documents"), WORDS).withColumnRenamed("score", "confidence")


@register(f"""WITH {_BM25}, k AS (SELECT id, score AS confidence FROM lex ORDER BY score DESC, id LIMIT 50)
SELECT id, round(power(contains(lower(text), 'license')::INT + contains(lower(text), 'moron')::INT, 2) / 2.0, 6) AS score, confidence FROM k JOIN documents ON doc_id = id WHERE lang IN ('en', 'de') ORDER BY score DESC, confidence DESC, id LIMIT 5""")
def lookup_describe(spark, d):
    """Over-fetch, drop ids without a passage, re-rank by coverage."""
    ranked = _lexical(spark, d).orderBy(F.desc("confidence"), "id").limit(context.depth(5))
    return context.rerank(ranked, t(spark, d, "documents").where("lang in ('en', 'de')"), context.query_tokens("License, a Moron!"), 5)


def _entities(spark, d):
    docs = t(spark, d, "documents").where("source is not null")
    return docs.groupBy(F.col("source").alias("entity")).agg(F.first("source").alias("name"), F.array(F.concat(F.lit("about license "), F.max("lang"))).alias("descriptions"), F.collect_list("doc_id").alias("passage_ids"))


def _passages(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("passage_id"), "text")


_SCORES = """
tk AS (SELECT source, unnest(['license', 'moro', 'src1', 'et']) AS w, doc_id FROM documents WHERE source IS NOT NULL),
hit AS (SELECT DISTINCT tk.source, w FROM tk JOIN documents d USING (doc_id) WHERE contains(lower(d.text), w)),
en AS (SELECT source AS entity, count(*) AS citations, (SELECT count(*) FROM hit WHERE hit.source = documents.source) AS src, 'about license ' || coalesce(max(lang), '') AS de FROM documents WHERE source IS NOT NULL GROUP BY source),
sc AS (SELECT entity, round((src + 2 * len(list_filter(['license', 'moro', 'src1', 'et'], lambda w: contains(de, w))) + 3 * len(list_filter(['license', 'moro', 'src1', 'et'], lambda w: contains(entity, w)))) / greatest(1.0, sqrt(citations)), 9) AS score, citations FROM en)
"""


@register(f"WITH {_SCORES} SELECT * FROM sc")
def entity_scores(spark, d):
    return context.entity_scores(_entities(spark, d), _passages(spark, d), ["license", "moro", "src1", "et"])


@register(f"""WITH {_SCORES}, {_BM25}, k AS (SELECT id FROM lex ORDER BY score DESC, id LIMIT 30), f AS (SELECT source AS entity, count(*) AS f FROM k JOIN documents ON doc_id = id GROUP BY source)
SELECT entity, round(10 * score + coalesce(f, 0), 9) AS rank_key FROM sc LEFT JOIN f USING (entity) ORDER BY rank_key DESC, entity LIMIT 6""")
def rank_entities(spark, d):
    entities = _entities(spark, d)
    hits = _lexical(spark, d).orderBy(F.desc("confidence"), "id").limit(30).select(F.col("id").alias("passage_id"))
    return context.rank_entities(context.entity_scores(entities, _passages(spark, d), ["license", "moro", "src1", "et"]), entities, hits, 6)


@register("SELECT n_nationkey, n_name FROM nation WHERE trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) = 'nation 7'")
def lookup_exact(spark, d):
    return context.by_name(t(spark, d, "nation"), " Nation-7", "n_name").select("n_nationkey", "n_name")


_HYDRATED = """WITH o AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000),
l AS (SELECT l_orderkey AS o_orderkey, list(l_linenumber || '/' || l_partkey || '/' || l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey AS o_orderkey, list(DISTINCT s_name) AS x FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"""


def _hydrated(spark, d, most=None):
    orders = t(spark, d, "orders").where("o_totalprice > 150000").select("o_orderkey")
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    suppliers = li.join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "s_name").distinct()
    return context.hydrate(orders, "o_orderkey", {"items": (li, ["l_linenumber", "l_partkey", "l_suppkey"], [], most), "suppliers": (suppliers, ["s_name"], [], most)})


def _shown(df):
    item = lambda x: F.concat_ws("/", x["l_linenumber"], x["l_partkey"], x["l_suppkey"])
    return df.select("o_orderkey", F.array_join(F.transform("items", item), ",").alias("items"), F.array_join(F.transform("suppliers", lambda x: x["s_name"]), ",").alias("suppliers"))


@register(f"{_HYDRATED} SELECT o.o_orderkey, coalesce(array_to_string(l.x, ','), '') AS items, coalesce(array_to_string(list_sort(s.x), ','), '') AS suppliers FROM o LEFT JOIN l USING (o_orderkey) LEFT JOIN s USING (o_orderkey)")
def hydrate_context(spark, d):
    """Kinds of children are put together by key before they meet, so that they don't multiply."""
    return _shown(_hydrated(spark, d))


@register(f"{_HYDRATED} SELECT o.o_orderkey, coalesce(array_to_string(l.x[:4], ','), '') AS items, coalesce(array_to_string(list_sort(s.x)[:3], ','), '') AS suppliers FROM o LEFT JOIN l USING (o_orderkey) LEFT JOIN s USING (o_orderkey)")
def compact_context(spark, d):
    return _shown(context.compact(_hydrated(spark, d), {}, {"items": 4, "suppliers": 3}))


@register("""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) > 60 THEN rtrim(left(x, 59)) || '…' ELSE x END AS text FROM c""".replace("\\v", "\\x0B"))
def compact_texts(spark, d):
    return context.compact(t(spark, d, "documents"), {"text": 60}, {}, ["lang", "source", "n_chars"])


@register("""WITH x AS (SELECT conv_id, turn, role AS a, text AS b, list_sort([coalesce(length(role), 0), coalesce(length(text), 0)]) AS n FROM conversations), l AS (SELECT *, greatest(40 // 2, 40 - n[1])::INT AS level FROM x)
SELECT conv_id, turn, left(a, level) AS a, left(b, level) AS b FROM l""")
def fitted_context(spark, d):
    """Two texts within a budget: what is above a common level gives way."""
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", context.fit_budget([F.col("role"), F.col("text")], ["a", "b"], 40).alias("s")).select("conv_id", "turn", "s.*")


@register("""WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS size FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
x AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS s, text, size, greatest(60, (600 // n) // 2) AS most FROM conversations JOIN c USING (conv_id) WHERE text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN size > 600 THEN CASE WHEN length(s) > most THEN rtrim(left(s, (most - 1)::INT)) || '…' ELSE s END ELSE text END AS text FROM x""")
def even_context(spark, d):
    """Texts of a conversation's turns, trimmed evenly where together they are over budget."""
    turns = t(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m"))
    whole = F.array_join(F.transform("m", lambda x: x["text"]), "")
    return turns.select("conv_id", F.explode(context.trim_evenly(F.col("m"), "text", whole, 600, 60)).alias("x")).select("conv_id", "x.turn", "x.text")


@register("SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 9, 40)")
def confirmed_evidence(spark, d):
    ids = spark.createDataFrame([(3,), (9,), (40,), (9,)], "doc_id long")
    return context.confirmed(ids, t(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@register("""SELECT doc_id AS id, CASE WHEN length(x) > 900 THEN rtrim(left(x, 899)) || '…' ELSE x END AS excerpt,
len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS words FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS x FROM documents)""")
def candidate_summaries(spark, d):
    return context.candidates(t(spark, d, "documents"), "doc_id", "text")
