"""Line dedup [native]: segment-partition edit join.

Lines are split into edits + 1 segments; if two lines are within `edits` edits, a segment of the shorter one
stands in the other unchanged. Each distinct line is indexed by (length, segment number, segment) and probes
the indexes of its own and up to `edits` smaller lengths with the substrings at the places where an alignment
within `edits` edits can put that segment. Lines found so are cut finer and paired where all but `edits` of the
finer segments agree. Where many agree, what they skip is cut finer in its turn, and in the end they are linked to one line for
each way to edit what is left, so that a group costs rows in proportion to its size. Candidates are verified by banded bit-parallel edit distance: a
column of the band's vertical differences is one long. Only DataFrame functions are used.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, components, durable, table

#: Lines of fewer characters are compared by equality only; two lines are near when at most so many edits apart.
LEAST_CHARS, EDITS = 24, 2
#: Segments of the finer cuts, by which lines that share a segment are looked over before they are paired.
FINE = 6
#: Up to so many rows of a finer key are paired. What more of them skip is cut again, down to so many characters.
PAIRED, SHORT = 32, 12
#: Common beginnings and ends are found in this many halvings: up to 2 ** 21 characters, any more stay. Tasks that verify.
LONGEST_BITS, SPREAD = 20, 64
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Sets of letters, beyond those that edits can touch, whose counts lines of a large group must share before they are cut again.
ALIKE = 3
#: Keys and hashes of candidate lines up to so many are sent to the lines (16 MB); more meet them in a shuffle.
BROADCAST_LINES = 1_000_000


def _place(length: Column, parts: int, k: Column) -> tuple[Column, Column]:
    """First place (from 1) and size of segment k; the last length % parts segments are one longer."""
    size, short = F.call_function("div", length, F.lit(parts)).cast("int"), F.lit(parts) - length % parts
    return size * k + F.greatest(k - short, F.lit(0)) + 1, size + F.when(k >= short, 1).otherwise(0)


def _key(line: Column, length: Column, k: Column, at: Column, size: Column, edits: int) -> Column:
    """line: in UTF-32, where a place is found without a walk over the characters before it. The last bits tell the length, modulo _turn."""
    return F.shiftleft(F.xxhash64(length, k, F.substr(line, (at - 1) * 4 + 1, size * 4)), edits.bit_length()).bitwiseOR(length.bitwiseAND(F.lit(_turn(edits) - 1)).cast("long"))


def _turn(edits: int) -> int:
    """A power of two above `edits`: lengths that differ by no more than `edits` differ modulo it."""
    return 1 << edits.bit_length()


def _index_keys(lines: DataFrame, edits: int) -> DataFrame:
    """lines: line (UTF-32), n, h. key, h for each segment. Segments are rows before their keys are made, so that the code for a key is there once and small enough to be compiled."""
    each = lines.select("*", F.explode(F.expr(f"array({','.join(map(str, range(edits + 1)))})")).alias("k"))
    return each.select(_key(F.col("line"), F.col("n"), F.col("k"), *_place(F.col("n"), edits + 1, F.col("k")), edits).alias("key"), "h")


def _probe_keys(lines: DataFrame, edits: int) -> DataFrame:
    """key, h: keys of the substrings that can equal a segment of a line shorter by 0 to `edits` characters.

    Segment k (from 0) of the shorter line is displaced by at most k edits before it and, counted from the
    end, edits - k after it; of several matching segments the first that satisfies both is enough.
    """
    cells = [(less, k, shift) for less in range(edits + 1) for k in range(edits + 1) for shift in range(-edits, edits + 1) if abs(shift) <= k and abs(shift - less) <= edits - k]
    each = lines.select("*", F.explode(F.expr(f"array({','.join(f'struct({x} as less, {k} as k, {y} as shift)' for x, k, y in cells)})")).alias("w"))
    n, k = F.col("n") - F.col("w.less"), F.col("w.k")
    at, size = _place(n, edits + 1, k)
    return each.select(_key(F.col("line"), n, k, at + F.col("w.shift"), size, edits).alias("key"), "h")


def _ways(edits: int) -> list[tuple]:
    """Finer cuts: (skipped segments, characters fewer, displacements after each of them), at first those of a line as it is.

    `edits` edits lie in at most as many of FINE segments of the shorter line. Between the skipped ones both lines
    agree, displaced by the edits so far; the steps of the displacement add up to at most `edits`.
    """
    skipped = list(itertools.combinations(range(FINE), edits))
    moves = []
    for less in range(edits + 1):
        for path in itertools.product(range(-edits, edits + 1), repeat=max(edits - 1, 0)):
            steps = (0, *path, less)
            if edits and any(steps) and sum(abs(y - x) for x, y in zip(steps, steps[1:])) <= edits:
                moves.append((less, steps[1:]))
    return [(c, 0, (0,) * edits) for c in skipped] + [(c, less, path) for c in skipped for less, path in moves]


def _literal(ways: list[tuple]) -> Column:
    ints = lambda x: f"array({','.join(map(str, x))})"
    cells = ",".join(f"named_struct('less',{less},'skip',{ints(c)},'move',{ints(m)})" for c, less, m in ways)
    return F.expr(f"cast(array({cells}) as array<struct<less:int,skip:array<int>,move:array<int>>>)")


def _cut(line: Column, w: Column, edits: int) -> tuple[list[Column], list[Column]]:
    """What stands for what way w doesn't skip, and the skipped segments."""
    n, begin, shift = F.char_length(line) - w["less"], F.lit(1), F.lit(0)
    kept, rest = [n, w["skip"]], []
    for k in range(edits):
        at, size = _place(n, FINE, F.get(w["skip"], F.lit(k)))
        move = F.get(w["move"], F.lit(k))
        kept.append(F.substr(line, begin + shift, at - begin))
        rest.append(F.substr(line, at + shift, size + move - shift))
        begin, shift = at + size, move
    return [*kept, F.substr(line, begin + shift, n - begin + 1)], rest


def _meeting(text: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """hi, hp: lines that meet in a finer key of PAIRED rows or fewer; g, h, line: the key, and what it skips, of lines in a key of more.

    text: g, h, line, turns. Lines of different g don't meet. Bit k of turns: a line that meets this one may have a length of k modulo _turn.
    Lines that differ in fewer segments than are skipped agree under several cuts. Only the cut that fills up with the first segments counts, so
    that two lines meet once, and a key whose lines differ in too few of what it skips has no rows.
    """
    ways = _ways(edits)
    own = sum(not any(m) for _, _, m in ways)
    each = text.select("g", "h", "line", "turns", F.posexplode(_literal(ways)).alias("way", "w"))
    length = (F.char_length("line") - F.col("w.less")).bitwiseAND(F.lit(_turn(edits) - 1))
    met = (F.col("way") < own) | (F.call_function("shiftright", F.col("turns"), length).bitwiseAND(F.lit(1)) == 1)
    kept, rest = _cut(F.col("line"), F.col("w"), edits)
    # null where skipped segment k is segment k: only there two lines of a key may be alike, as other cuts hold them too
    differ = [F.when(F.get("w.skip", F.lit(k)) != k, F.xxhash64(rest[k])).alias(f"r{k}") for k in range(edits)]
    rows = each.where(met).select(F.xxhash64("g", "w.skip", *kept).alias("key"), "g", "h", "way", *differ)
    ends = [f(f"r{k}").alias(f"{n}{k}") for k in range(edits) for n, f in (("lo", F.min), ("hi", F.max))]
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("way").alias("least"), *ends)
    apart = "".join(f" and (lo{k} is null or lo{k} <> hi{k})" for k in range(edits))
    rows = durable(rows.join(_sent(keys.where(f"lo <> hi and least < {own}{apart}").select("key", "n")), "key"))
    few = rows.where(f"n <= {PAIRED}")
    index = few.where(f"way < {own}").select("key", F.col("h").alias("hi"), *[F.col(f"r{k}").alias(f"i{k}") for k in range(edits)])
    probe = few.select("key", "way", F.col("h").alias("hp"), *[f"r{k}" for k in range(edits)])
    apart = "".join(f" and (r{k} is null or r{k} <> i{k})" for k in range(edits))
    pairs = index.join(probe, "key").where(f"hi <> hp and (way >= {own} or hi < hp){apart}").select("hi", "hp")
    many = rows.where(f"n > {PAIRED}").join(text.select("g", "h", "line"), ["g", "h"]).withColumn("w", F.element_at(_literal(ways), F.col("way") + 1))
    # a line that is itself what a key left may stand in its group more than once: the key tells which one is meant
    again = many.where(F.xxhash64("g", "w.skip", *kept) == F.col("key")).select(F.col("key").alias("g"), "h", F.concat_ws("\n", *rest).alias("line")).distinct()
    return pairs, again


def _alike(text: DataFrame, letters: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """hi, hp: lines of one g that share ALIKE sets' letter counts with few others; the rows of `text` that share them with more than PAIRED.

    text: g, h, line; letters: h, c, n (the length of a line). An edit changes two letters' counts at most, so that of 2 * edits + ALIKE sets some ALIKE stay as they are.
    """
    sets = 2 * edits + ALIKE
    half = sum((F.get("c", F.lit(k)) for k in range(0, len(LETTERS), 2)), F.lit(0))
    some = letters.select("h", "n", half.alias("half"), *[F.xxhash64(*[F.get("c", F.lit(k)) for k in range(x, len(LETTERS), sets)], F.lit(x)).alias(f"s{x}") for x in range(sets)])
    keys = [F.xxhash64("g", F.lit(k), *[f"s{x}" for x in which]) for k, which in enumerate(itertools.combinations(range(sets), ALIKE))]
    rows = text.select("g", "h").distinct().join(some, "h").select("g", "h", "n", "half", F.explode(F.array(*keys)).alias("key"))
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    rows = durable(rows.join(_sent(met), "key"))
    few = rows.where(f"k <= {PAIRED}")
    one, two = few.select("key", F.col("h").alias("hi"), "n", "half"), few.select("key", F.col("h").alias("hp"), F.col("n").alias("m"), F.col("half").alias("part"))
    pairs = one.join(two, "key").where(f"hi < hp and abs(n - m) <= {edits} and abs(half - part) <= {edits}").select("hi", "hp")
    return pairs, text.join(rows.where(f"k > {PAIRED}").select("g", "h").distinct(), ["g", "h"], "left_semi")


def _stars(text: DataFrame, edits: int) -> DataFrame:
    """hi, hp: pairs of `edits` edits at most that connect all such pairs of one g; text: g, h, line (SHORT characters at most).

    Each line stands under what is left after removing up to `edits` characters, told apart by which of them are only replaced, and where. Two
    lines under one key are as many edits apart as both have lost, and as are replaced in both. The one that has lost the fewest is within
    reach of every line there that has anything within reach, so that it alone is linked to them. Line ends join what was skipped and are never removed.
    """
    cells = []
    for k in range(edits + 1):
        for at in itertools.combinations(range(1, SHORT + 1), k):
            for lost in itertools.product((True, False), repeat=k):
                gone = [p for p, x in zip(at, lost) if x]
                cells.append((at, [p - sum(q < p for q in gone) for p, x in zip(at, lost) if not x], len(gone)))
    ints = lambda x: f"array({','.join(map(str, x))})"
    kind = "array<struct<at:array<int>,swapped:array<int>,lost:int>>"
    structs = ",".join(f"named_struct('at',{ints(a)},'swapped',{ints(s)},'lost',{n})" for a, s, n in cells)
    literal = F.expr(f"cast(array({structs}) as {kind})")
    each = text.select("g", "h", "line", F.explode(literal).alias("x"))
    each = each.where(F.forall("x.at", lambda p: (p <= F.char_length("line")) & (F.substr("line", p, F.lit(1)) != "\n")))
    parts, begin = [], F.lit(1)
    for k in range(edits + 1):
        end = F.coalesce(F.get("x.at", F.lit(k)), F.lit(SHORT + 1))
        parts.append(F.substr("line", begin, F.greatest(end - begin, F.lit(0))))
        begin = end + 1
    rows = each.select(F.xxhash64("g", "x.swapped", F.concat(*parts)).alias("key"), "h", F.col("x.lost").alias("lost"), F.size("x.swapped").alias("swapped"))
    keys = rows.groupBy("key").agg(F.min(F.struct("lost", "h")).alias("first"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    met = rows.join(_sent(keys.where("lo <> hi").select("key", "first")), "key").where((F.col("h") != F.col("first.h")) & (F.col("lost") + F.col("first.lost") + F.col("swapped") <= edits))
    return met.select(F.col("first.h").alias("hi"), F.col("h").alias("hp"))


def letter_counts(line: Column) -> Column:
    """How often each letter a to z, of either case, stands in a line."""
    low = F.lower(line)
    return F.array(*[F.length(low) - F.length(F.replace(low, F.lit(x), F.lit(""))) for x in LETTERS])


def same_letters(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines' letter_counts differ by no more than `edits` edits can make them differ."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        total = total + F.abs(F.get(a, F.lit(k)) - F.get(b, F.lit(k)))
    return total <= 2 * edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether a and b are at most `edits` edits apart, by a banded bit-parallel pass (2 * edits + 1 <= 61).

    Bit r of a band column j stands for row j + r - edits of the distance matrix (rows: b, columns: a). plus and
    minus hold where the distance rises or falls by one down the column; a column's diagonal differences follow
    from them and the matches of a's character in b's rows of the band. The distance is followed along the band's
    last diagonal to b's last row, then along that row.
    """
    # the characters are fields of one array element, so that they are split once and not at every step
    both = F.array(F.struct(F.split(b, "").alias("p"), F.split(a, "").alias("t"), F.char_length(a).alias("n"), F.char_length(b).alias("m")))
    near = F.element_at(F.transform(both, lambda z: _banded(z["p"], z["t"], z["n"], z["m"], edits)), 1)
    return F.when(F.greatest(F.char_length(a), F.char_length(b)) <= edits, True).otherwise((F.abs(F.char_length(a) - F.char_length(b)) <= edits) & near)


def _banded(p: Column, t: Column, n: Column, m: Column, edits: int) -> Column:
    """Whether the m characters p and the n characters t are at most `edits` edits apart."""
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def match(j: Column) -> Column:
        c = F.get(t, j - 1)
        bits = [F.when(F.get(p, j + (r - edits - 1)) == c, F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long")) for r in range(width)]
        out = bits[0]
        for x in bits[1:]:
            out = out.bitwiseOR(x)
        return out

    low = lambda c: c.bitwiseAND(F.lit(mask).cast("long"))
    inv = lambda c: low(F.bitwise_not(c))

    def first(s: Column, j: Column) -> Column:  # diagonal differences d, horizontal rises and falls
        x = match(j)
        add = low(x.bitwiseAND(s["plus"]) + s["plus"]).bitwiseXOR(s["plus"])
        d = add.bitwiseOR(x).bitwiseOR(s["minus"])
        return F.struct(s["plus"].alias("plus"), s["minus"].alias("minus"), d.alias("d"), s["far"].alias("far"))

    def second(s: Column, j: Column) -> Column:
        rise = s["minus"].bitwiseOR(inv(s["d"].bitwiseOR(s["plus"])))
        fall = s["d"].bitwiseAND(s["plus"])
        down = F.call_function("shiftrightunsigned", s["d"], F.lit(1))
        on_diagonal = j + edits <= m
        bit = F.call_function("shiftrightunsigned", rise, (m - j + edits).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        sink = F.call_function("shiftrightunsigned", fall, (m - j + edits).cast("int")).bitwiseAND(F.lit(1).cast("long"))
        along = F.call_function("shiftrightunsigned", s["d"], F.lit(2 * edits)).bitwiseAND(F.lit(1).cast("long"))
        far = s["far"] + F.when(on_diagonal, 1 - along).otherwise(bit - sink)
        return F.struct(fall.bitwiseOR(inv(down.bitwiseOR(rise))).alias("plus"), down.bitwiseAND(rise).alias("minus"), F.lit(0).cast("long").alias("d"), far.alias("far"))

    # column 0: rows 1 to edits + 1 rise; the last diagonal starts in row `edits`
    begin = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("plus"), F.lit(0).cast("long").alias("minus"), F.lit(0).cast("long").alias("d"), F.least(F.lit(edits).cast("long"), m.cast("long")).alias("far"))
    columns = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(columns, begin, lambda s, j: _then(first, second, s, j))["far"] <= edits


def _then(first, second, s: Column, j: Column) -> Column:
    """second(first(s)), the intermediate state being computed once."""
    return F.element_at(F.transform(F.array(first(s, j)), lambda x: second(x, j)), 1)


def _contested(lines: DataFrame, edits: int) -> DataFrame:
    """h, turns: hashes of the lines that probe a key of another line, or are found by one; bits of the lengths they probed with success, modulo _turn.

    A key's index lines meet the probes as their smallest and largest hash, so that a key with many lines costs
    one row a line and not one a pair. They have one row a key, so a table of them in memory has no hot key.
    """
    own = lines.select(F.encode("line", "UTF-32").alias("line"), F.char_length("line").alias("n"), F.xxhash64("line").alias("h"))
    index, probe = _index_keys(own, edits), _probe_keys(own, edits).withColumnRenamed("h", "hp")
    ends = index.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    met = durable(ends.hint("shuffle_hash").join(probe, "key").where("lo <> hp or hi <> hp").select("key", "hp").distinct())
    keys = met.select("key").distinct()
    turn = F.call_function("shiftleft", F.lit(1), F.col("key").bitwiseAND(F.lit(_turn(edits) - 1)).cast("int"))
    found = index.join(_sent(keys), "key", "left_semi").select("h", F.lit(0).alias("turns"))
    return met.select(F.col("hp").alias("h"), turn.alias("turns")).union(found).groupBy("h").agg(F.bit_or("turns").alias("turns"))


def _sent(few: DataFrame) -> DataFrame:
    """`few`, marked for broadcast where its counted rows are no more than BROADCAST_LINES."""
    few = durable(few)
    return F.broadcast(few) if few.count() <= BROADCAST_LINES else few


def near_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """a, b: md5 of different lines at most `edits` edits apart, enough to connect all such; lines: `line`, LEAST_CHARS or more, repeats allowed.

    Lines that share a segment with another are looked over once more by finer cuts, before any two are paired. All pairs come
    of keys of PAIRED rows or fewer; of larger ones, those between a line and others within its reach.
    """
    wanted = _sent(_contested(lines, edits))
    text = durable(lines.select("line", F.xxhash64("line").alias("h")).join(wanted, "h").select("line", "h", "turns").distinct().withColumn("c", letter_counts(F.col("line"))))
    pairs, again = _meeting(text.select(F.lit(0).cast("long").alias("g"), "h", "line", "turns"), edits)
    text = text.drop("turns")
    # what is skipped is shorter each time: about a third. Lines whose letters differ are no longer in it
    while not (again := durable(again)).isEmpty():
        met, again = _alike(again, text.select("h", "c", F.char_length("line").alias("n")), edits)
        pairs, again = pairs.union(met), durable(again)
        pairs = pairs.union(_stars(again.where(F.char_length("line") <= SHORT), edits))
        met, again = _meeting(again.where(F.char_length("line") > SHORT).withColumn("turns", F.lit((1 << _turn(edits)) - 1)), edits)
        pairs = pairs.union(met)
    pairs = pairs.select(F.least("hi", "hp").alias("hi"), F.greatest("hi", "hp").alias("hp")).distinct()
    x, y = text.toDF("x", "hi", "lx"), text.toDF("y", "hp", "ly")
    met = pairs.join(x, "hi").join(y, "hp").where((F.abs(F.char_length("x") - F.char_length("y")) <= edits) & same_letters(F.col("lx"), F.col("ly"), edits)).select("x", "y")
    met = durable(_cores(met).where(F.abs(F.char_length("cx") - F.char_length("cy")) <= edits).repartition(SPREAD, F.xxhash64("x", "y")))
    return met.where(within(F.col("cx"), F.col("cy"), edits)).select(F.unhex(F.md5("x")).alias("a"), F.unhex(F.md5("y")).alias("b"))


def _cores(pairs: DataFrame) -> DataFrame:
    """x, y, and cx, cy: what is left of them without their common beginning and end, which cost no edits."""
    steps = F.array(*[F.lit(1 << k) for k in range(LONGEST_BITS, -1, -1)])

    def common(x: Column, y: Column) -> Column:
        most = F.least(F.char_length(x), F.char_length(y))
        return F.aggregate(steps, F.lit(0), lambda n, w: n + F.when((n + w <= most) & (F.substr(x, n + 1, w) == F.substr(y, n + 1, w)), w).otherwise(0))

    def rest(c: Column, n: Column) -> Column:
        return F.reverse(F.substr(c, n + 1, F.lit(1 << 30)))

    # between the halves the rows are struct fields of one array element, so that no expression is repeated
    half = F.transform(F.array(common(F.col("x"), F.col("y"))), lambda n: F.struct(rest(F.col("x"), n).alias("x"), rest(F.col("y"), n).alias("y")))
    whole = F.transform(half, lambda c: F.element_at(F.transform(F.array(common(c["x"], c["y"])), lambda n: F.struct(rest(c["x"], n).alias("x"), rest(c["y"], n).alias("y"))), 1))
    return pairs.select("x", "y", F.explode(whole).alias("c")).select("x", "y", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, tkey, n_lines, n_eligible, n_removed, n_near, removed for each distinct (id, text) of `docs`.

    Lines are what \\n separates. Of the lines of `least` characters or more that reach each other by steps of at most
    `edits` edits, the first stays, in order of id (null last), text hash and line number; the others are removed:
    their numbers (from 0) are listed. n_near counts those that differ from the one that stays. Lines below
    LEAST_CHARS reach only equal ones, and need a word. Lines shorter than `least` are never removed. Null and empty texts have no line to remove.
    Repeated rows are one document. tkey is the hash of the text.
    """
    if least < 1 or 2 * edits + 1 > 61 or LEAST_CHARS <= edits:
        raise ValueError("least must be 1 or more, and edits at most 30 and below LEAST_CHARS")
    fits = lambda s: (F.char_length(s) >= least) & ((F.char_length(s) >= LEAST_CHARS) | s.rlike(WORD))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    each = own.select("doc_id", "tkey", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    eligible = each.where(fits(F.col("line")))
    near = durable(near_lines(eligible.where(F.char_length("line") >= LEAST_CHARS).select("line"), edits))
    roots = components(near).toDF("id", "root")
    rows = eligible.select("doc_id", "tkey", "at", F.unhex(F.md5("line")).alias("id")).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tkey", "at")
    first = rows.groupBy("root").agg(F.min(place).alias("first"), F.min_by("id", place).alias("first_id"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    gone = rows.join(first, "root").where(~((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("tkey") == F.col("first.tkey")) & (F.col("at") == F.col("first.at"))))
    per = gone.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_set("at")).alias("removed"), F.count_distinct(F.when(F.col("id") != F.col("first_id"), F.col("at"))).alias("n_near")).select(F.col("doc_id").alias("d"), F.col("tkey").alias("k"), "removed", "n_near")
    size = F.size(F.split("text", "\n", -1)).cast("long")
    fit = F.size(F.filter(F.split("text", "\n", -1), fits)).cast("long")
    base = own.select("doc_id", "tkey", size.alias("n_lines"), fit.alias("n_eligible")).distinct()
    both = base.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tkey") == F.col("k")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return both.select("doc_id", "tkey", "n_lines", "n_eligible", F.size(removed).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """`docs` with the removed lines taken out of the text; all rows and other columns stay, whatever their names.

    Null texts stay null, empty ones empty. Repeated rows lose the same lines: the first of a class stays in each of them. Rows without an
    id are told apart by their text, and come last where a class decides which line stays. Empty table: empty result.
    """
    gone = line_classes(docs, id_col, text_col, edits, least).where("n_removed > 0").select(F.col("doc_id").alias("__d"), F.col("tkey").alias("__k"), F.col("removed").alias("__gone"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("__id", F.col(id_col).cast("long"))
    met = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__key") == F.col("__k")), "left")
    left = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda s, i: ~F.array_contains("__gone", i)), "\n")
    return met.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed lines of every document, lines of any length; nulls, empties, ties and repeats as in line_classes, other columns ignored."""
    return line_classes(table(spark, sf_dir, "documents"), least=1).select("doc_id", "n_lines", "n_eligible", "n_removed", "n_near", "removed")
