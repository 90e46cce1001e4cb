"""Queries through stored indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import fulltext, ivf
from .catalog import register, t


@register("""WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), st AS (SELECT count(*) AS docs, avg(len(w)) AS avg_n FROM tok),
q AS (SELECT item_id AS question, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')[:6])) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT question, doc_id AS id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_n))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY question, doc_id)
SELECT question, id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def indexed_bm25(spark, d):
    """The ten best documents for the first six tokens of every benchmark item, from one index of all documents."""
    path = ivf.index_path(spark, "fulltext")
    fulltext.build(t(spark, d, "documents"), path)
    questions = t(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.slice(tokens(F.col("text")), 1, 6).alias("terms"))
    found, _ = fulltext.search(spark, path, questions, 10)
    return found.select("question", "id", "score", F.col("rank").cast("long").alias("rank"))


@register()
def ivf_neighbors(spark, d):
    """The ten nearest of every vec_id divisible by 20 from the inverted lists, and whether each is among the exact ten; recall of each question."""
    rows, path = t(spark, d, "embeddings"), ivf.index_path(spark, "ivf")
    centroids = ivf.build(rows, path)
    asked = ivf.usable(rows, "vec_id", "embedding").where("id % 20 = 0")
    found = ivf.neighbors(spark, path, centroids, asked, 10, ivf.calibrated(spark, path, centroids, asked, 10))
    exact = ivf.exact_neighbors(spark, path, asked, 10)
    counts = ivf.recall(found, exact).select(F.col("question").alias("q"), (F.col("hits") / F.col("wanted")).alias("recall"))
    there = exact.select(F.col("question").alias("eq"), F.col("id").alias("ei"))
    met = found.join(there, (F.col("question") == F.col("eq")) & (F.col("id") == F.col("ei")), "left").join(counts, F.col("question") == F.col("q"))
    return met.select(F.col("question").alias("vec_id"), "rank", F.col("id").alias("neighbor"), F.col("score").alias("cosine"), F.col("eq").isNotNull().alias("exact"), "recall")
