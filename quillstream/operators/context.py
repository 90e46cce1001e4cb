"""From ranked ids to answers: modes, over-fetch and re-ranking, entity ranks, hydration, compact context, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ellipsis, norm_key, tokens
from . import search


def query_text(parts: list[tuple[str, Column]], focus: list[str]) -> Column:
    """A struct (query, focus): all given parts with their labels, one a line; the focus parts' texts alone, one a line, or the query
    where none of them is given. Null and empty parts are left out."""
    given = [(label, F.when(c != "", c)) for label, c in parts]
    query = F.concat_ws("\n", *[F.concat(F.lit(label + ": "), c) for label, c in given])
    own = F.concat_ws("\n", *[c for label, c in given if label in focus])
    return F.struct(query.alias("query"), F.when(own != "", own).otherwise(query).alias("focus"))


def query_tokens(text: str, longer_than: int = 2, stop: tuple[str, ...] = ()) -> list[str]:
    """Distinct tokens of a query: runs of a-z and 0-9 of the lower-cased text, longer than so many characters, no stop words."""
    import re

    return sorted({w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) > longer_than and w not in stop})


def depth(limit: int) -> int:
    """How many ids are fetched for an answer of `limit`."""
    return max(30, 10 * limit)


def rerank(ranked: DataFrame, passages: DataFrame, terms: list[str], limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, confidence of the `limit` best ranked ids that have a passage: by coverage of the query's tokens, then confidence, then id.

    ranked: id, confidence. Ids without a passage are dropped.
    """
    met = ranked.join(passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t")), "id")
    scored = met.select("id", search.coverage(F.coalesce("__t", F.lit("")), terms).alias("score"), "confidence")
    return scored.orderBy(F.desc("score"), F.desc("confidence"), "id").limit(limit)


def entity_scores(entities: DataFrame, passages: DataFrame, terms: list[str]) -> DataFrame:
    """entity, score, citations: (matches in cited text + 2 in descriptions + 3 in the name) / max(1, root of citations).

    entities: entity, name, descriptions (an array), passage_ids (an array, repeats count as citations); passages: passage_id,
    text. A match is a query token that the lower-cased text contains, inside a word too. Cited passages tell which tokens they
    contain, and only those bits meet the entities, so no entity's whole text is ever put together. Null arrays and texts are empty.
    """
    bits = lambda c: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(F.lower(c), F.lit(x)), 1 << k).otherwise(0).cast("long") for k, x in enumerate(some)])
    lots = [sorted(set(terms))[k : k + 60] for k in range(0, len(set(terms)), 60)]
    ids = F.coalesce("passage_ids", F.array().cast(dict(entities.dtypes)["passage_ids"]))
    own = entities.select("entity", F.size(ids).cast("long").alias("citations"), F.coalesce(F.array_join("descriptions", " "), F.lit("")).alias("__d"), F.coalesce("name", F.lit("")).alias("__n"))
    if not lots:
        return own.select("entity", F.lit(0.0).alias("score"), "citations")
    cited, hits, seen = entities.select("entity", F.explode(F.array_distinct(ids)).alias("passage_id")), passages.select("passage_id", "text"), []
    desc = name = F.lit(0)
    for k, some in enumerate(lots):
        hits = hits.withColumn(f"__w{k}", bits(F.coalesce("text", F.lit(""))))
        seen.append(F.bit_or(f"__w{k}").alias(f"__s{k}"))
        desc, name = desc + F.bit_count(bits(F.col("__d"))), name + F.bit_count(bits(F.col("__n")))
    per = cited.join(hits.drop("text"), "passage_id").groupBy("entity").agg(*seen)
    src = reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"__s{k}"), F.lit(0)) for k in range(len(lots))])
    return own.join(per, "entity", "left").select("entity", F.round(search.specificity(src, desc, name, F.col("citations")), 9).alias("score"), "citations")


def rank_entities(scores: DataFrame, entities: DataFrame, retrieved: DataFrame, limit: int) -> DataFrame:
    """entity, rank_key of the `limit` first by 10 * score + number of retrieved passages that cite it, then entity.

    retrieved: passage_id. All entities take part, those without a match too.
    """
    cited = entities.select("entity", F.explode(F.array_distinct("passage_ids")).alias("passage_id")).join(retrieved.select("passage_id").distinct(), "passage_id")
    freq = cited.groupBy("entity").agg(F.count(F.lit(1)).alias("__f"))
    key = F.round(10 * F.col("score") + F.coalesce("__f", F.lit(0)), 9)
    return scores.join(freq, "entity", "left").select("entity", key.alias("rank_key")).orderBy(F.desc("rank_key"), "entity").limit(limit)


def by_name(entities: DataFrame, name: str, name_col: str = "name") -> DataFrame:
    """Exact mode: entities of that normalised name."""
    return entities.where(norm_key(F.col(name_col)) == norm_key(F.lit(name)))


#: Rows, children among them, of a task that puts children together, about.
HELD = 250_000


def hydrate(rows: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str], list[str], int | None]]) -> DataFrame:
    """rows with an array of structs for each kind of children: (frame with `key`, order, fields, most).

    Children are aggregated by key before they meet the rows, so that kinds don't multiply. A row without has empty arrays. All are dealt
    by key to one task for HELD rows of the largest frame, so that what a task holds doesn't grow with the tables; one key's children are one row.
    """
    parts = max(1, *(-(-df.count() // HELD) for df in (rows, *(x[0] for x in children.values()))))
    rows = rows.repartition(parts, key)
    wanted = rows.select(key).distinct()
    for name, (frame, order, fields, most) in children.items():
        extra = [f for f in fields if f not in order]
        items = F.array_sort(F.collect_list(F.struct(*order, *extra)))
        per = frame.repartition(parts, key).join(wanted, key, "left_semi").groupBy(key).agg((F.slice(items, 1, most) if most else items).alias(name))
        kind = per.schema[name].dataType
        rows = rows.join(per, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return rows


def compact(rows: DataFrame, text: dict[str, int], arrays: dict[str, int], dropped: list[str] = ()) -> DataFrame:
    """rows with texts cut to so many characters (ellipsis), arrays to so many entries, and `dropped` columns left out."""
    for c, n in text.items():
        rows = rows.withColumn(c, ellipsis(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), n))
    for c, n in arrays.items():
        rows = rows.withColumn(c, F.slice(c, 1, n))
    return rows.drop(*dropped)


def fit_budget(fields: list[Column], names: list[str], most: int) -> Column:
    """A struct of texts whose lengths sum up to `most` at most: those above a common level are cut there, shorter ones stay whole.

    The level is the highest that fits. Null texts have no length and stay null.
    """
    sizes = F.array_sort(F.array(*[F.coalesce(F.char_length(f), F.lit(0)) for f in fields]))
    n = len(fields)
    # with the k shortest whole, the others share what is left; the greatest of these shares is the level
    shares = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((F.lit(most) - F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, x: a + x)) / (F.lit(n) - k)))
    level = F.greatest(F.array_max(shares), F.lit(0)).cast("int")
    return F.struct(*[F.substr(f, F.lit(1), level).alias(x) for f, x in zip(fields, names)])


def trim_evenly(matches: Column, field: str, encoded: Column, most: int, least: int = 1000) -> Column:
    """An array of structs whose text `field` is cut to one allowance for all, with an ellipsis, where the `encoded` whole is longer than `most`.

    The allowance is half of an even share of `most`, `least` at least; the other fields stay as they are.
    """
    allowance = F.greatest(F.lit(least), F.floor(F.floor(F.lit(most) / F.greatest(F.size(matches), F.lit(1))) / 2)).cast("int")

    def cut(x: Column) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(x[field], F.lit("")), r"\s+", " "))
        return F.when(F.char_length(text) > allowance, F.concat(F.rtrim(F.substr(text, F.lit(1), allowance - 1)), F.lit("…"))).otherwise(text)

    return F.when(F.char_length(encoded) > most, F.transform(matches, lambda x: x.withField(field, cut(x)))).otherwise(matches)


def confirmed(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The known rows of the ids; when it is run, an unknown id raises."""
    from .lookup import require

    return require(ids.select(key).distinct(), known, key)


def candidates(rows: DataFrame, id_col: str, text_col: str, most: int = 900) -> DataFrame:
    """id, excerpt (ellipsis after `most` characters), words of each row, for a choice among them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.col(id_col).alias("id"), ellipsis(F.trim(text), most).alias("excerpt"), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long").alias("words"))
