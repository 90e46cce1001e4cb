"""Lookup joins: references that must exist, defaults, labels, aliases, fuzzy names, best records, hydration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key


def require(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Inner join on key; when it is run, a row whose key isn't among the parents raises. Parents have one row a key."""
    met = rows.join(parents.withColumn("__there", F.lit(True)), key, "left")
    told = F.concat(F.lit("no parent of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return met.where(F.when(F.col("__there"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("__there")


def missing(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among the parents, null keys too."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def with_default(rows: DataFrame, table: DataFrame, key: str, defaults: dict) -> DataFrame:
    """rows with the table's columns; where the key isn't there, or its value is null, the default."""
    met = rows.join(table.select(key, *defaults), key, "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(c), F.lit(v) if not isinstance(v, Column) else v).alias(c) for c, v in defaults.items()])


def label_refs(rows: DataFrame, labels: DataFrame, scope: str, refs: str, label: str, target: str) -> DataFrame:
    """rows with `target`s (sorted, distinct) of the labels that `refs` (an array) names within the same scope.

    Labels match by normalised key; of equal ones in a scope the least target is meant. Refs that match nothing are dropped.
    """
    known = labels.groupBy(F.col(scope).alias("__scope"), norm_key(F.col(label)).alias("__key")).agg(F.min(target).alias("__target"))
    keyed = rows.withColumn("__id", F.monotonically_increasing_id()) if "__id" not in rows.columns else rows
    named = keyed.select(*keyed.columns, F.explode_outer(refs).alias("__ref")).withColumn("__k", norm_key(F.col("__ref")))
    met = named.join(known, (F.col(scope) == F.col("__scope")) & (F.col("__k") == F.col("__key")), "left")
    return met.groupBy(*keyed.columns).agg(F.sort_array(F.collect_set("__target")).alias(target)).drop("__id")


def linked(rows: DataFrame, parents: DataFrame, scope: str, ref: str, name: str) -> DataFrame:
    """rows whose `ref` names a parent of the same scope, by normalised key."""
    known = parents.select(F.col(scope).alias("__scope"), norm_key(F.col(name)).alias("__key")).distinct()
    return rows.join(known, (F.col(scope) == F.col("__scope")) & (norm_key(F.col(ref)) == F.col("__key")), "left_semi")


def relevant(rows: DataFrame, names: str, evidence: str) -> DataFrame:
    """rows one of whose names (an array) stands in their evidence, case ignored; blank names never do."""
    low = F.lower(F.coalesce(F.col(evidence), F.lit("")))
    return rows.where(F.exists(F.coalesce(F.col(names), F.array().cast("array<string>")), lambda n: (F.trim(n) != "") & F.contains(low, F.lower(F.trim(n)))))


def first_member(rows: DataFrame, arrays: DataFrame, value: str, array: str, order: str, needed: bool = False) -> DataFrame:
    """rows with the first, in order, of the arrays that hold their value; null where none does, or, if it is needed, an error when run."""
    first = arrays.select(F.explode(array).alias("__v"), order).groupBy("__v").agg(F.min(order).alias("__first"))
    met = rows.join(first, F.col(value) == F.col("__v"), "left")
    if needed:
        told = F.concat(F.lit(f"no {array} holds "), F.coalesce(F.col(value).cast("string"), F.lit("null")))
        met = met.where(F.when(F.col("__v").isNotNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return met.select(*rows.columns, F.col("__first").alias(order))


def _first_told(described: DataFrame, links: DataFrame, passages: DataFrame, n: int) -> DataFrame:
    """__e, near: of each entity the first n of the linked passages that describe it. links: entity, near."""
    told = described.select("entity", F.col("passage").alias("near")).distinct().join(links, ["entity", "near"], "left_semi").join(passages.select(F.col("passage").alias("near")), "near", "left_semi")
    return told.withColumn("__n", F.row_number().over(Window.partitionBy("entity").orderBy("near"))).where(F.col("__n") <= n).select(F.col("entity").alias("__e"), "near")


def neighbor_passages(anchors: DataFrame, passages: DataFrame, links: DataFrame, described: DataFrame, radius: int = 2, limit: int = 6) -> DataFrame:
    """entity, passage, near, place (1..limit): passages of evidence beside an anchor, of which each is linked to the entity.

    First those within `radius` of the anchor in its group, in order, then the others that describe the entity, in the order of
    their ids. anchors, links and described: entity, passage; passages: passage, group, seq. The anchor itself isn't beside it. Offsets and
    descriptions are equi-joins; links are met before anything is cut. Of an entity's linked descriptions only the first limit + 1 can be
    among an anchor's first: those before one are beside the anchor, have a place of their own, or are the anchor.
    """
    at = passages.select(F.col("passage").alias("__p"), "group", "seq")
    asked = anchors.select("entity", "passage").distinct()
    here = asked.join(at, F.col("passage") == F.col("__p")).drop("__p")
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1) if k])
    wanted = here.select("entity", "passage", "group", F.col("seq"), F.explode(steps).alias("step")).withColumn("__seq", F.col("seq") + F.col("step")).drop("seq")
    other = passages.select(F.col("passage").alias("near"), F.col("group").alias("__g"), F.col("seq").alias("__s"))
    close = wanted.join(other, (F.col("group") == F.col("__g")) & (F.col("__seq") == F.col("__s"))).select("entity", "passage", "near", F.col("step").alias("rank"))
    linked_ = links.select("entity", F.col("passage").alias("near")).distinct()
    close = close.join(linked_, ["entity", "near"], "left_semi").select("entity", "passage", "near", "rank")
    told = _first_told(described, linked_, passages, limit + 1)
    far = asked.join(told, F.col("entity") == F.col("__e")).where(F.col("near") != F.col("passage")).select("entity", "passage", "near", F.lit(radius + 1).alias("rank"))
    both = close.unionByName(far).groupBy("entity", "passage", "near").agg(F.min("rank").alias("rank"))
    order = F.row_number().over(Window.partitionBy("entity", "passage").orderBy("rank", "near"))
    return both.withColumn("place", order).where(F.col("place") <= limit).select("entity", "passage", "near", "place")


#: Characters of a gram that contained keys are looked up by; shorter keys are no candidates.
GRAM = 4


def _grams(c: Column) -> Column:
    n = F.char_length(c) - GRAM + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(c, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def _rarest(parts: DataFrame, wholes: DataFrame, cols: list[str]) -> DataFrame:
    """What may be contained, by `cols`, with that one of its grams (`__g`) which the fewest of the wholes have; left out where none has one of them."""
    common = wholes.groupBy("__g").agg(F.count(F.lit(1)).alias("__m"))
    rare = parts.join(common, "__g", "left").groupBy(*cols).agg(F.min(F.struct(F.coalesce("__m", F.lit(0)).alias("m"), F.col("__g").alias("g"))).alias("__r"))
    return rare.where("__r.m > 0").select(*cols, F.col("__r.g").alias("__g"))


def fuzzy_cascade(rows: DataFrame, table: DataFrame, first: str, second: str, key: str, order: str) -> DataFrame:
    """rows with the table's key that they match, and how: equal to `first`, else to `second`, else the first key in order
    that contains `first` or is contained in it, both of GRAM characters or more.

    Contained keys are looked up by their grams: of the contained key's grams the one that the fewest others have stands in the other.
    """
    known = table.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__order"))
    one = rows.join(known.select(F.col("__key").alias("__a")), F.col(first) == F.col("__a"), "left").join(known.select(F.col("__key").alias("__b")), F.col(second) == F.col("__b"), "left")
    left = one.where("__a is null and __b is null").select(F.col(first).alias("__n")).where(F.char_length("__n") >= GRAM).distinct()
    long_keys = known.where(F.char_length("__key") >= GRAM)
    of_name, of_key = left.withColumn("__g", F.explode(_grams(F.col("__n")))), long_keys.withColumn("__g", F.explode(_grams(F.col("__key"))))
    in_name = of_name.join(_rarest(of_key, of_name, ["__key", "__order"]), "__g").where(F.contains("__n", "__key"))
    in_key = of_key.join(_rarest(of_name, of_key, ["__n"]), "__g").where(F.contains("__key", "__n"))
    cols = ["__n", "__key", "__order"]
    near = in_name.select(*cols).unionByName(in_key.select(*cols)).groupBy("__n").agg(F.min_by("__key", F.struct("__order", "__key")).alias("__c"))
    out = one.join(near, F.col(first) == F.col("__n"), "left")
    how = F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").when(F.col("__c").isNotNull(), "contained")
    return out.select(*rows.columns, F.coalesce("__a", "__b", F.when(how == "contained", F.col("__c"))).alias(key), how.alias("how"))


def best_record(rows: DataFrame, table: DataFrame, ids: str, name: str, table_id: str, table_name: str, richness: str) -> DataFrame:
    """rows with the record that `ids` (an array, in order of preference) names first, else the one of their normalised
    name; of the records of that name the richest is taken instead where it is richer, the least id on ties.

    Rows meet records by what they ask for (ids and name), asked once however many rows ask it; no row needs a number.
    """
    known = table.select(F.col(table_id).alias("__tid"), norm_key(F.col(table_name)).alias("__tkey"), F.col(richness).alias("__rich"))
    asked = rows.select(F.col(ids).alias("__ids")).where(F.col("__ids").isNotNull()).distinct()
    named = asked.select("__ids", F.posexplode("__ids").alias("__pos", "__tid")).join(known, "__tid")
    by_id = named.groupBy("__ids").agg(F.min_by(F.struct("__tid", "__tkey", "__rich"), "__pos").alias("__i"))
    best = known.groupBy("__tkey").agg(F.min_by(F.struct("__tid", "__rich"), F.struct((-F.col("__rich")).alias("r"), "__tid")).alias("__best"))
    met = rows.join(by_id, F.col(ids) == F.col("__ids"), "left").withColumn("__k", F.coalesce("__i.__tkey", norm_key(F.col(name)))).join(best, F.col("__k") == F.col("__tkey"), "left")
    better = F.col("__i").isNull() | (F.col("__best.__rich") > F.col("__i.__rich"))
    return met.select(*rows.columns, F.when(better, F.col("__best.__tid")).otherwise(F.col("__i.__tid")).alias(table_id))


def prefer(rows: DataFrame, enriched: DataFrame, current: DataFrame, key: str, value: str, has: Column) -> DataFrame:
    """rows with the enriched table's value where `has` holds of it (an expression over `value`), else the current one's."""
    a, b = enriched.select(key, F.col(value).alias("__a")), current.select(key, F.col(value).alias("__b"))
    met = rows.join(a, key, "left").join(b, key, "left").withColumn(value, F.col("__a"))
    return met.withColumn(value, F.when(F.coalesce(has, F.lit(False)), F.col("__a")).otherwise(F.col("__b"))).drop("__a", "__b")


def speakers(rows: DataFrame, guesses: DataFrame, scope: str, speaker: str, name: str) -> DataFrame:
    """rows with the name guessed for their speaker within their scope; without a guess the speaker's own label."""
    known = guesses.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "").groupBy(scope, speaker).agg(F.min(name).alias("__name"))
    return rows.join(known, [scope, speaker], "left").withColumn(name, F.coalesce("__name", speaker)).drop("__name")


def zip_arrays(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Structs of the entries of equal place; as many as the shorter array has. A null array counts as empty."""
    n = F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in (left, right)])
    places = F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))
    return F.transform(places, lambda i: F.struct(F.get(left, i).alias(names[0]), F.get(right, i).alias(names[1])))


def contains_join(quotes: DataFrame, texts: DataFrame, quote: str, text: str, key: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every pair of a quote and a text that contains it; with a `key`, only of equal key. Null quotes and texts match nothing, an empty quote matches every text.

    Columns: those of `quotes`, and of `texts` those in `keep` (all). Without a key, texts are read once through an automaton of
    the quotes (match_patterns), and what they contain meets the quotes by equality.
    """
    quotes = quotes.where(F.col(quote).isNotNull())
    keep = texts.columns if keep is None else list(keep)
    if key:
        return quotes.join(texts.select(*{key: 0, text: 0, **dict.fromkeys(keep)}), key).where(F.contains(text, quote)).select(*quotes.columns, *[c for c in keep if c != key])
    from .patterns import match_patterns

    met = match_patterns(texts, quotes, quote, text, keep, "__pattern")
    return met.join(quotes, F.col("__pattern") == F.col(quote)).select(*quotes.columns, *keep)
