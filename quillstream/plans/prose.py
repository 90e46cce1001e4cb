"""Queries of the rules for cited prose, over the documents' own sentences and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import text as T
from ..operators import folds
from .catalog import register, t

#: Sentences as quoted_sentences cuts them.
_CUT = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '([.!?…])["''”’]? ([A-Z“"''\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '^\*{2,}\s*', ''))), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)"""


def _docs(spark, d):
    return t(spark, d, "documents").where("text is not null")


@register(rf"""WITH {_CUT} SELECT doc_id, coalesce(list_filter(s, lambda x: regexp_matches(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:license|que)(?:$|[^\p{{L}}\p{{N}}_])'))[1], s[1], '') AS mention FROM s""")
def first_mentions(spark, d):
    """The first sentence that names one of two terms, else the first one."""
    return _docs(spark, d).select("doc_id", E.first_mention(F.col("text"), F.array(F.lit("license"), F.lit("que"))).alias("mention"))


@register(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, b, list_filter(range(2, len(b) + 1), lambda i: regexp_matches(b[i], '^(?:De|An)')) AS stop FROM b)
SELECT doc_id, coalesce(array_to_string(CASE WHEN len(stop) > 0 THEN b[: stop[1] - 1] ELSE b END, chr(10) || chr(10)), '') AS block FROM c""")
def first_blocks(spark, d):
    """Lines as paragraphs, up to the first that begins like a new scene."""
    wide = F.replace(F.col("text"), F.lit("\n"), F.lit("\n \n"))
    return _docs(spark, d).select("doc_id", E.first_block(wide, r"^(?:De|An)").alias("block"))


@register(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, p, list_transform(p, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'ouen')) AS n FROM p),
a AS (SELECT doc_id, list_distinct(list_filter(p, lambda x, i: len(list_filter(n[greatest(i - 2, 1) : i + 1], lambda y: y)) > 0 AND (contains(lower(x), 'the') OR contains(lower(x), 'des')))) AS a FROM n)
SELECT doc_id, array_to_string(list_sort(a), '|') AS near FROM a""")
def adjacent_paragraphs(spark, d):
    """Lines with a visual term, from one before a line that names someone to two after it."""
    near = E.adjacent(F.split("text", "\n"), F.array(F.lit("license"), F.lit("Ouen")), ["the", "des"])
    return _docs(spark, d).select("doc_id", F.array_join(F.sort_array(near), "|").alias("near"))


@register(rf"""WITH {_CUT}, m AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
k AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY (2 * contains(lower(x), 'oi')::INT + 3 * contains(lower(x), 'sh')::INT) DESC, i DESC) AS place FROM m WHERE regexp_matches(x, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:the|des|der|los)(?:$|[^\p{{L}}\p{{N}}_])'))
SELECT doc_id, place, x AS sentence FROM k WHERE place <= 5""")
def ranked_sentences(spark, d):
    """The five most specific mentions of a document: by the weight of what they contain, later ones first."""
    ranked = E.ranked_mentions(E.quoted_sentences(F.col("text")), ["the", "des", "der", "los"], {"oi": 2, "sh": 3}, 5)
    return _docs(spark, d).select("doc_id", F.posexplode(ranked).alias("at", "sentence")).select("doc_id", (F.col("at") + 1).cast("long").alias("place"), "sentence")


@register(r"""WITH n AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z'']+')[:6], lambda w: length(w) > 0) AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, [array_to_string(w[1:2], ' '), coalesce(w[3], ''), 'The ' || array_to_string(w[4:6], ' ')] AS names FROM n),
c AS (SELECT doc_id, unnest(names) AS name FROM x),
k AS (SELECT doc_id, trim(regexp_replace(trim(name), '(?i)^(?:the|mr)\s+', '')) AS core FROM c),
g AS (SELECT doc_id, core, list_filter(regexp_extract_all(core, '[A-Za-z'']+'), lambda w: length(w) > 2) AS w FROM k),
r AS (SELECT doc_id, core AS term FROM g WHERE len(w) > 1 UNION SELECT doc_id, w[len(w)] FROM g WHERE len(w) > 0 AND length(w[len(w)]) >= 4 AND lower(w[len(w)]) NOT IN ('the', 'that'))
SELECT d.doc_id, coalesce(string_agg(term, '|' ORDER BY length(term) DESC, term), '') AS terms FROM x d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""")
def name_patterns(spark, d):
    """What may stand for the names that a document's first words make, longest first."""
    w = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z']+"), 0), 1, 6)
    names = F.array(F.array_join(F.slice(w, 1, 2), " "), F.coalesce(F.get(w, F.lit(2)), F.lit("")), F.concat(F.lit("The "), F.array_join(F.slice(w, 4, 3), " ")))
    return _docs(spark, d).select("doc_id", F.array_join(E.name_terms(names, ["the", "mr"], ["the", "that"]), "|").alias("terms"))


@register("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: len(list_filter(regexp_split_to_array(x, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, list_transform(range(0, len(n) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)) AS p FROM l),
c(doc_id, n, p, sequence, first, last) AS (
 SELECT doc_id, n, p, 0, 0, len(list_filter(range(1, len(n)), lambda j: p[j + 1] < 60 AND p[j + 2] <= 90)) FROM p
 UNION ALL SELECT doc_id, n, p, sequence + 1, greatest(first + 1, last), greatest(first + 1, last) + len(list_filter(range(greatest(first + 1, last) + 1, len(n)), lambda j: p[j + 1] - p[greatest(first + 1, last) + 1] < 60 AND p[j + 2] - p[greatest(first + 1, last) + 1] <= 90)) FROM c WHERE last < len(n) - 1)
SELECT doc_id, sequence, first::INT AS first, last::INT AS last, (p[last + 2] - p[first + 1])::BIGINT AS words FROM c""")
def chunked_lines(spark, d):
    """Lines of a document as paragraphs; chunks of 60 to 90 words with one line of overlap."""
    docs = _docs(spark, d).select("doc_id", F.transform(F.split("text", "\n"), lambda x: T.word_count(x)).alias("n"))
    held = lambda c: F.aggregate(F.slice("n", c["first"] + 1, c["last"] - c["first"] + 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", "n", F.posexplode(folds.word_budget(F.col("n"), 60, 90, 1)).alias("sequence", "c")).select("doc_id", "sequence", "c.first", "c.last", held(F.col("c")).alias("words"))
