"""String, id and timecode expressions. All take and return columns and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends; empty: unknown."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def norm_key(c: Column) -> Column:
    """Key for alias lookups: as slug, with blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def dedup_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def digest_id(prefix: str, *parts: Column) -> Column:
    """prefix, colon, the first 24 hex digits of the parts' SHA-256, parts joined by 0x1F; nulls count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 24))


def entity_id(kind: str, name: Column, named: Column, passage_id: Column) -> Column:
    """Unnamed entities are local to their passage."""
    return F.when(named, F.concat(F.lit(kind + ":"), slug(name))).otherwise(F.concat(F.lit(kind + ":"), passage_id, F.lit(":"), slug(name)))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def tokens(c: Column, longer_than: int = 0, stop: tuple[str, ...] = ()) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: (F.length(t) > longer_than) & ~t.isin(*stop)) if longer_than or stop else found


def sentences(c: Column) -> Column:
    """Split after . ! or ? and white space; blank sentences dropped."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm, rounded to milliseconds first."""
    ms = F.bround(seconds * 1000).cast("long")
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return F.format_string("%02d:%02d:%02d.%03d", div(ms, 3_600_000), div(ms, 60_000) % 60, div(ms, 1000) % 60, ms % 1000)


def parse_timecode(c: Column) -> Column:
    """Seconds of [[HH:]MM:]SS[.mmm]; null where it isn't one."""
    p = F.reverse(F.split(c, ":"))
    part = lambda k: F.coalesce(F.get(p, F.lit(k)).try_cast("double"), F.when(F.size(p) <= k, 0.0))
    return part(0) + 60 * part(1) + 3600 * part(2)


#: Spellings that mean unknown. Records that were written with them have to be read alike.
FILLERS = ("not specified", "unspecified", "unknown", "n/a", "na", "none", "not stated", "not mentioned")


def has_value(c: Column, fillers: tuple[str, ...] = FILLERS) -> Column:
    """Blank texts and texts that begin with a filler (as whole words, a hyphen being as good as a blank) mean unknown."""
    begins = r"(?is)^\s*(?:" + "|".join(f.replace(" ", r"[\s-]") for f in fillers) + r")\b.*"
    return (F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.coalesce(c, F.lit("")).rlike(begins)


def trait(c: Column) -> Column:
    return F.when(has_value(c), F.trim(c)).otherwise(F.lit(""))


def article(c: Column) -> Column:
    return F.when(c.rlike("(?i)^[aeiou]"), "an").otherwise("a")


def ellipsis(c: Column, most: int) -> Column:
    """White space collapsed; at most `most` characters, the last an ellipsis if something was cut. Null is empty."""
    c = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 1))), F.lit("…"))).otherwise(c)


def ellipsis_at_blank(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.left(c, F.lit(most)), " [^ ]*$", ""), F.lit("…"))).otherwise(c)


def normalize_page(c: Column) -> Column:
    """Drops NULs, takes tabs for blanks, joins hyphenated line ends, collapses blanks (no-break ones too) and more than one
    empty line, trims white space at the ends."""
    c = F.translate(F.replace(c, F.lit("\x00"), F.lit("")), "\t", " ")
    c = F.regexp_replace(c, r"(?<=[\p{L}\p{N}_])-\n(?=[\p{L}\p{N}_])", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[ \u00a0]+", " "), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def url_path(c: Column) -> Column:
    """Backslashes as slashes, each segment percent-encoded."""
    return F.array_join(F.transform(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def json_slice(c: Column) -> Column:
    """From the first { to the last }; empty if there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def repaired(json: Column, texts: list[str] = (), lists: list[str] = (), counts: list[str] = ()) -> Column:
    """A struct of the fields of a JSON object that stands in a text, of the kind that each must have, whatever it is there.

    texts: null is empty, anything but a text is its JSON. lists: null is empty, what isn't a list is a list of it, entries that are no
    texts are their JSON. counts: whole numbers, cut off, not below 0; no number is 0. Without an object all fields are empty.
    """
    m = F.from_json(json_slice(json), "map<string,string>")
    value = lambda c: F.try_element_at(m, F.lit(c))
    empty = F.array().cast("array<string>")
    as_list = lambda v: F.when(v.isNull(), empty).when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    number = lambda v: F.greatest(F.lit(0).cast("long"), F.coalesce(v.try_cast("double").try_cast("long"), F.lit(0).cast("long")))
    return F.struct(*[F.coalesce(value(c), F.lit("")).alias(c) for c in texts], *[as_list(value(c)).alias(c) for c in lists], *[number(value(c)).alias(c) for c in counts])


def timecode_floored(seconds: Column) -> Column:
    """HH:MM:SS.mmm with hours and minutes cut off first and the seconds rounded, so that they can show 60.000."""
    minutes = F.floor(seconds / 60).cast("long")
    return F.format_string("%02d:%02d:%06.3f", F.call_function("div", minutes, F.lit(60)), minutes % 60, seconds - minutes * 60)


def find_timecode(c: Column) -> Column:
    """Seconds of the first timecode ([H:]MM:SS[.mmm]) that stands in a text; null without one."""
    part = lambda k: F.regexp_extract(c, r"(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)", k)
    return F.when(part(3) != "", F.coalesce(part(1).try_cast("double"), F.lit(0.0)) * 3600 + part(2).try_cast("double") * 60 + part(3).try_cast("double"))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before an attempt (0, 1, ...): doubled each time, plus the jitter, `most` at most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt) + (F.lit(0.0) if jitter is None else jitter), F.lit(most))


def least_number(c: Column) -> Column:
    """The least of the whole numbers in a text; null without one."""
    return F.array_min(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), 0), lambda x: x.try_cast("long")))


def rewrite_suffix(json: Column, old: str, new: str) -> Column:
    """(json, changes): the JSON text with strings that end in `old` ending in `new`, and how many there were."""
    pattern = r'("(?:[^"\\]|\\.)*)\Q' + old + r'\E"'
    return F.struct(F.regexp_replace(json, pattern, "$1" + new + '"').alias("json"), F.regexp_count(json, F.lit(pattern)).cast("long").alias("changes"))


def lookup(mapping: dict[str, str], key: Column, default: Column) -> Column:
    """A map's value of the key, else the default."""
    if not mapping:
        return default
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key), default)
