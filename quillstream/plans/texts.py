"""Queries of text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..functions.udfs import canonical_json as canonical_json_udf
from .catalog import register, t

_WS = r"[ \t\n\r\f\x0B]+"


def _docs(spark, d):
    return t(spark, d, "documents").where("text is not null")


@register(rf"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def whitespace_collapse(spark, d):
    return _docs(spark, d).select("doc_id", E.collapse(F.col("text")).alias("text"))


@register("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[:3], '-') AS slug FROM documents WHERE text IS NOT NULL")
def short_slug(spark, d):
    return _docs(spark, d).select("doc_id", E.short_slug(F.col("text")).alias("slug"))


@register(rf"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("words"))


@register(r"""WITH x AS (SELECT doc_id, replace(text, 'e', chr(9)) || '  ' || chr(160) || 'wo-' || chr(10) || 'rd' || chr(10) || chr(10) || chr(10) || chr(10) || 'end ' AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(p, chr(0), ''), chr(9), ' '), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '[ ' || chr(160) || ']+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')), '^\s+|\s+$', '', 'g') AS page FROM x""")
def page_normalize(spark, d):
    p = F.concat(F.translate("text", "e", "\t"), F.lit("  \xa0wo-\nrd\n\n\n\nend "))
    return _docs(spark, d).select("doc_id", T.normalize_page(p).alias("page"))


@register(r"SELECT doc_id, len(regexp_extract_all(text, '(?im)^(Chapter[ \t]+\d+|[A-Z][a-z]+\.)[ \t]*$')) AS n FROM documents WHERE text IS NOT NULL")
def chapter_headings(spark, d):
    return _docs(spark, d).select("doc_id", F.size(E.headings(F.col("text"), r"Chapter[ \t]+\d+|[A-Z][a-z]+\.")).cast("long").alias("n"))


@register("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS named FROM part""")
def with_article(spark, d):
    return t(spark, d, "part").select("p_partkey", E.with_article(F.col("p_name")).alias("named"))


@register("""SELECT p_partkey, array_to_string(list_filter(['name ' || p_name, 'made ' || p_type, p_brand], lambda s: s <> ''), '. ') AS portrait FROM part""")
def portrait_parts(spark, d):
    """The last part repeats the third, and one is unknown: neither is told."""
    p = [("name", F.col("p_name")), ("size", F.lit("Not-specified here")), ("made", F.col("p_type")), ("", F.col("p_brand")), ("", F.lower("p_brand"))]
    return t(spark, d, "part").select("p_partkey", E.portrait(p).alias("portrait"))


@register("""SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), '^4') THEN '' ELSE o_orderstatus || ', belt' END AS items FROM orders""")
def clean_list(spark, d):
    raw = F.when(F.col("o_orderpriority").startswith("4"), F.lit("n/a, hat")).otherwise(F.concat(F.col("o_orderstatus"), F.lit(", Varnish,, "), F.lower("o_orderstatus"), F.lit(", tool: x, belt, BELT")))
    return t(spark, d, "orders").select("o_orderkey", E.clean_list(raw, ["varnish", "bark"]).alias("items"))


@register("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'found' END AS kind FROM supplier""")
def hash_suffix_lookup(spark, d):
    key = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "fox").otherwise("cat"), F.lit("-00ab12cd"))
    return t(spark, d, "supplier").select("s_suppkey", F.coalesce(T.lookup({"fox": "found"}, key, F.lit(None)), T.lookup({"fox": "found"}, E.without_hash(key), F.lit(None))).alias("kind"))


@register("""SELECT doc_id, CASE WHEN s = '' THEN 'none' ELSE s END AS terms FROM (SELECT doc_id, array_to_string(list_filter(['license', 'idiot', 'the'], lambda w: contains(lower(text), w)), ', ') AS s FROM documents WHERE text IS NOT NULL)""")
def found_terms(spark, d):
    return _docs(spark, d).select("doc_id", E.found_terms(F.col("text"), ["license", "idiot", "the"], "none").alias("terms"))


@register(r"""SELECT doc_id, nullif(regexp_extract(text, '([A-Z][a-z]+) der ([a-z]+)', 2), '') AS word FROM documents WHERE text IS NOT NULL""")
def first_match(spark, d):
    return _docs(spark, d).select("doc_id", E.first_match(F.col("text"), "([A-Z][a-z]+) der ([a-z]+)", 2).alias("word"))


@register(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name, 'ring', 'band', 'gi'), 'small band', 'bandlet', 'gi') AS name FROM part""")
def ordered_substitution(spark, d):
    return t(spark, d, "part").select("p_partkey", E.substitute(F.col("p_name"), [("RING", "band"), ("small band", "bandlet")]).alias("name"))


@register("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'p' || (['/a', '/b', '/c'])[(l_linenumber - 1) % 3 + 1] AS prompt FROM lineitem""")
def variation_suffix(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", E.variation(F.lit("p"), F.col("l_linenumber"), ["/a", "/b", "/c"]).alias("prompt"))


@register(r"""SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b', 1), ',') AS names FROM conversations""")
def named_entities(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), 1), ",").alias("names"))


@register("""SELECT doc_id, array_to_string(list_filter(['license', 'moron'], lambda w: contains(lower(text), w)), ',') AS forbidden, array_to_string(list_filter(['the', 'und'], lambda w: NOT contains(lower(text), w)), ',') AS missing FROM documents WHERE text IS NOT NULL""")
def phrase_check(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(E.present_phrases(F.col("text"), ["license", "moron"]), ",").alias("forbidden"), F.array_join(E.missing_phrases(F.col("text"), ["the", "und"]), ",").alias("missing"))


@register("""SELECT c_custkey, 'the ' || lower(c_mktsegment) AS phrase FROM customer""")
def short_phrases(spark, d):
    s = F.concat("c_name", F.lit(" belongs to the "), F.lower("c_mktsegment"), F.lit(", so it is; and more."))
    return t(spark, d, "customer").select("c_custkey", E.short_phrase(s, F.col("c_name"), ["belongs to", "is the", "is an?"]).alias("phrase"))


@register("""SELECT event_id, json_extract(props, '$.k')::VARCHAR AS k FROM events""")
def fenced_json(spark, d):
    made = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t(spark, d, "events").select("event_id", F.get_json_object(E.without_fence(made), "$.k").alias("k"))


@register("""SELECT event_id, printf('%02d:%02d:%06.3f', (floor(value * 61 / 60)::BIGINT) // 60, (floor(value * 61 / 60)::BIGINT) % 60, value * 61 - 60 * floor(value * 61 / 60)) AS code FROM events""")
def timecodes_floored(spark, d):
    return t(spark, d, "events").select("event_id", T.timecode_floored(F.col("value") * 61).alias("code"))


@register("""SELECT event_id, (event_id % 60) * 60 + (event_id % 50) + 0.5 AS seconds FROM events""")
def found_timecodes(spark, d):
    s = F.format_string("cut at %d:%02d.5 of the film", F.col("event_id") % 60, F.col("event_id") % 50)
    return t(spark, d, "events").select("event_id", T.find_timecode(s).alias("seconds"))


@register("SELECT event_id, round(value / 7, 3) AS value, least(0.98, greatest(0.05, value / 50)) AS clamped FROM events")
def rounded_clamped(spark, d):
    return t(spark, d, "events").select("event_id", F.round(F.col("value") / 7, 3).alias("value"), F.least(F.lit(0.98), F.greatest(F.lit(0.05), F.col("value") / 50)).alias("clamped"))


@register("SELECT l_linenumber, max(least(1.5 * pow(2, l_linenumber), 60)) AS wait FROM lineitem GROUP BY l_linenumber")
def backoff_delay(spark, d):
    return t(spark, d, "lineitem").groupBy("l_linenumber").agg(F.max(T.backoff(F.col("l_linenumber"), 1.5)).alias("wait"))


@register("""SELECT event_id, '{"a":"v.mp4","b":' || json_extract(props, '$.k')::VARCHAR || ',"c":["x.webm.txt","' || event_type || '.mp4"]}' AS json, 2 AS changes FROM events""")
def rewritten_json(spark, d):
    made = F.concat(F.lit('{"a":"v.webm","b":'), F.get_json_object("props", "$.k"), F.lit(',"c":["x.webm.txt","'), "event_type", F.lit('.webm"]}'))
    return t(spark, d, "events").select("event_id", T.rewrite_suffix(made, ".webm", ".mp4").alias("x")).select("event_id", "x.json", F.col("x.changes").cast("int").alias("changes"))


@register("""SELECT event_id, '{"a":"é","k":' || json_extract(props, '$.k')::VARCHAR || '}' AS json FROM events""")
def canonical_json(spark, d):
    made = F.concat(F.lit('{ "k" : '), F.get_json_object("props", "$.k"), F.lit(', "a": "é"}'))
    return t(spark, d, "events").select("event_id", canonical_json_udf(made).alias("json"))


@register("SELECT o_orderkey, least(o_orderkey, o_custkey) AS least FROM orders")
def least_number(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.least_number(F.concat(F.lit("Chapters "), "o_orderkey", F.lit(", "), "o_custkey", F.lit(" and on"))).alias("least"))


@register("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def map_lookup(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.lookup({"F": "finished", "O": "open"}, F.col("o_orderstatus"), F.col("o_orderstatus")).alias("status"))


@register(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '([.!?…])["''”’]? ([A-Z“"''\[])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, trim(regexp_replace(x, '^\*{2,}\s*', '')) AS x FROM s)
SELECT doc_id, count(*) AS n, sum(length(x))::BIGINT AS chars FROM m WHERE x <> '' GROUP BY doc_id""")
def quoted_sentences(spark, d):
    x = _docs(spark, d).select("doc_id", E.quoted_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return x.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, y: a + F.length(y)).alias("chars"))
