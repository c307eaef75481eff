"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines are made distinct first. Two lines within THRESHOLD edits share, for one of THRESHOLD + 1
segments of the shorter, that segment as a substring of the longer near its place. So each distinct
line gives one index row per segment, keyed by a 64-bit hash of (segment number, its length, segment),
and probes the indexes of its own and of up to THRESHOLD smaller lengths with those substrings alone
that a match can need (the multi-match-aware windows). Only keys and line numbers are shuffled.

A bucket (a key's lines) is never expanded into its pairs:
  1. its leader, the indexed line of the least number, is tried against each other member, and the
     links found give a first set of components;
  2. a bucket of more than BLOCK lines is split again by what else its lines share. Two edits spoil two of
     PARTS pieces of a line at most, so of any three pieces of an indexed line one stands in every line
     linked to it, near its place: its three rarest pieces in the bucket are its keys there, and lines that
     share nothing but the bucket's segment do not meet;
  3. then the indexed and probing lines meet as arrays, block by block (BLOCK lines or BLOCK_CHARS
     characters at most), and a block gives only a number of links for each line and the pairs of
     components that a link joins. A pair counts in its first common bucket, and piece, alone.
A candidate is verified in two steps. Two edits spoil two of PARTS pieces of a line at most, so all
others have to stand in the other line near their places; and what is left goes through a banded
bit-parallel edit distance: the 2 * threshold + 1 diagonals of the table are bits of a long, and a
fold over the longer line's characters updates them all at once. No link is lost.

Lines that share a segment and a piece that is rare there are compared each with each, so time, and rows of
blocks (texts of 2 * BLOCK lines), go with the square of their number: the number of links of each line is
part of the result.

Defined results: a null text has no lines; blank lines take no part; lines of under least characters
(LEAST unless given; the query gives 1, so that all are met) match only when equal; lines of any
length are compared whole; a null id is the smallest; repeated rows count as further copies; an empty
table gives an empty result; other columns are ignored (dedup_lines keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, unwritten, written
from .components import components

THRESHOLD, LEAST = 2, 16
PARTS, BLOCK, BLOCK_CHARS = 8, 64, 1 << 20


def lines_of(docs: DataFrame, *keys: str) -> DataFrame:
    """keys (doc_id unless given), line_no, line of every line that is not blank."""
    cut = docs.select(*(keys or ("doc_id",)), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return cut.filter(F.col("line").rlike(r"\S"))


def segment(length: Column, k: int, i: Column) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of the k segments of a line; the last ones are the longer."""
    length = length.cast("int")
    base, more = ((length - length % k) / k).cast("int"), length % k
    return base * i + F.greatest(F.lit(0), i - (k - more)) + 1, base + F.when(i >= k - more, 1).otherwise(0)


def key(i: Column, length: Column, part: Column) -> Column:
    return F.xxhash64(i, length.cast("int"), part)


def places(threshold: int, probing: bool) -> list[tuple[int, int, int]]:
    """(less, segment, shift): the segments of a line that is less characters shorter, moved by shift. A line's
    own places in the index come first; probing adds those that a match can need."""
    k = threshold
    own, out = [(0, i, 0) for i in range(k + 1)], []
    for less in range(k + 1 if probing else 0):
        for i in range(k + 1):
            low, high = max(-i, less - (k - i)), min(i, less + (k - i))
            out += [(less, i, shift) for shift in range(low, high + 1) if less or shift]
    return own + out


def rows(places: list[tuple[int, int, int]]) -> Column:
    return F.array(*(F.struct(F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for less, i, shift in places))


def key_at(line: Column, n: Column, at: Column, threshold: int) -> Column:
    """The key of one place; null for one outside the line."""
    length = (n - at["less"]).cast("int")
    start, size = segment(length, threshold + 1, at["i"])
    start = start + at["shift"]
    return F.when((length >= 1) & (start >= 1) & (start + size <= n + 1), key(at["i"], length, F.substr(line, start, size)))


def keys_of(line: Column, n: Column, threshold: int, probing: bool) -> Column:
    """The keys of all places as one array, for few lines."""
    return F.transform(rows(places(threshold, probing)), lambda at: key_at(line, n, at, threshold))


def placed(lines: DataFrame, threshold: int, probing: bool) -> DataFrame:
    """lines with a row for each place: key, and whether the line is in the index there. One place a row
    keeps the generated code small."""
    each = lines.select("line_id", "line", "n", F.explode(rows(places(threshold, probing))).alias("at"))
    own = (F.col("at.less") == 0) & (F.col("at.shift") == 0)
    found = each.select("line_id", key_at(F.col("line"), F.col("n"), F.col("at"), threshold).alias("key"), own.alias("indexed"))
    return found.filter("key IS NOT NULL")


def first_key(x: Column, n: Column, y: Column, m: Column, threshold: int) -> Column:
    """The first of x's keys in the index that y (m characters) looks up."""
    return let(keys_of(y, m, threshold, True), lambda looked: F.get(F.filter(keys_of(x, n, threshold, False), lambda k: F.array_contains(looked, k)), F.lit(0)))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def edit_distance(x: Column, y: Column, threshold: int) -> Column:
    """The edit distance of x and y, in code points, exact up to threshold (more means more). y has as many
    characters as x or up to threshold more. Bit b of a column's vectors is row j - threshold + b of the
    table; the result is the sum of the steps that are not 0 along the last cell's diagonal."""
    k, band = threshold, (1 << (2 * threshold + 1)) - 1
    padded, chars = F.concat(F.array_repeat(F.lit(""), k), F.split(x, "")), F.split(y, "")

    def column(at: Column, char: Column, padded: Column, more: Column) -> Column:
        equal = F.lit(0)
        for b in range(2 * k + 1):
            equal = equal.bitwiseOR(F.when(F.get(padded, at["j"] + b) == char, 1 << b).otherwise(0))
        plus, minus = at["plus"], at["minus"]  # rows whose step down is +1, -1

        def diagonal(eq: Column) -> Column:
            return ((eq.bitwiseAND(plus) + plus).bitwiseXOR(plus)).bitwiseOR(eq).bitwiseOR(minus).bitwiseAND(F.lit(band))

        def onward(zero: Column) -> Column:
            right_plus = minus.bitwiseOR(F.bitwise_not(zero.bitwiseOR(plus))).bitwiseAND(F.lit(band))
            right_minus, next_zero = zero.bitwiseAND(plus), F.shiftright(zero, 1)
            return F.struct(
                (at["j"] + 1).alias("j"),
                right_minus.bitwiseOR(F.bitwise_not(next_zero.bitwiseOR(right_plus))).bitwiseAND(F.lit(band)).alias("plus"),
                next_zero.bitwiseAND(right_plus).alias("minus"),
                (at["steps"] + F.when((at["j"] >= more) & (zero.bitwiseAND(F.call_function("shiftleft", F.lit(1), k - more)) == 0), 1).otherwise(0)).alias("steps"),
            )

        return let(equal, lambda eq: let(diagonal(eq), onward))

    def fold(both: Column) -> Column:
        more = F.size(both["y"]) - F.size(both["x"]) + k
        start = F.struct(F.lit(0).alias("j"), F.lit(band & ~((1 << k) - 1)).alias("plus"), F.lit(0).alias("minus"), F.lit(0).alias("steps"))
        return let(more, lambda m: F.aggregate(both["y"], start, lambda at, char: column(at, char, both["x"], m), lambda at: at["steps"] + m))

    return let(F.struct(padded.alias("x"), chars.alias("y")), fold)


def n_pieces(threshold: int) -> int:
    return max(PARTS, threshold + 1)


def may_link(x: Column, n: Column, y: Column, threshold: int) -> Column:
    """Whether enough pieces of x (n characters) stand in y near their places."""

    def stands(i: Column) -> Column:
        a, size = segment(n, n_pieces(threshold), i)
        start = F.greatest(a - threshold, F.lit(1))
        return F.contains(F.substr(y, start, a + size + threshold - start), F.substr(x, a, size))

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(n_pieces(threshold) - 1)), stands)) >= n_pieces(threshold) - threshold


def within(x: Column, n: Column, y: Column, threshold: int) -> Column:
    """Whether x of n characters and y, as long or up to threshold longer, are threshold edits apart at most."""
    return may_link(x, n, y, threshold) & (edit_distance(x, y, threshold) <= threshold)


def pieces(y: Column, n: Column, threshold: int, shifts: int) -> Column:
    """Hashes of what stands in y at the places of the pieces of a line of n characters, and up to shifts
    away: may_link for lines that meet many others."""
    k = n_pieces(threshold)

    def piece(at: Column) -> Column:
        start, size = segment(n, k, at["i"])
        start = start + at["shift"]
        return F.when(start >= 1, key(at["i"], size, F.substr(y, start, size)))

    return F.array_distinct(F.transform(rows([(0, i, shift) for i in range(k) for shift in range(-shifts, shifts + 1)]), piece))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """line_id, line, n (characters), first_doc_id, n_copies; a table, so that line_id stands."""
    no_id = F.max(F.col("doc_id").isNull())
    each = lines_of(docs).groupBy("line").agg(F.min("doc_id").alias("least"), no_id.alias("no_id"), F.count("*").alias("n_copies"))
    return written(each.select("line", F.length("line").alias("n"), F.when(~F.col("no_id"), F.col("least")).alias("first_doc_id"), "n_copies", F.monotonically_increasing_id().alias("line_id")))


def buckets(lines: DataFrame, threshold: int, least: int) -> DataFrame:
    """key, leader, id, indexed: each other member of every bucket of several lines; indexed if it is in the index there."""
    taken = lines.filter(F.col("n") >= least)
    leaders = placed(taken, threshold, False).groupBy("key").agg(F.min("line_id").alias("leader"))
    probes = placed(taken, threshold, True).withColumnRenamed("line_id", "id")
    others = leaders.join(probes.hint("merge"), "key").filter("id <> leader")
    return others.groupBy("key", "leader", "id").agg(F.max("indexed").alias("indexed"))  # a line may have a key at several places


def in_blocks(side: DataFrame, into: str) -> DataFrame:
    """side: key, piece, own (a struct with id and n). Rows of key, piece, block and an array of own."""
    sizes = side.groupBy("key", "piece").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("own.n") / BLOCK_CHARS)).alias("blocks"))
    dealt = side.join(sizes, ["key", "piece"]).withColumn("block", F.pmod(F.xxhash64("own.id"), "blocks"))
    return dealt.groupBy("key", "piece", "block").agg(F.collect_list("own").alias(into)).withColumnRenamed("block", f"{into}_block")


def meetings(xs: DataFrame, ys: DataFrame, threshold: int) -> DataFrame:
    """xs (indexed) and ys: key, own (structs with id, n, line, component, pieces). Blocks of both that meet: key, piece,
    xs, ys, xs_block, ys_block. In small buckets piece is 0; in others the x of a pair has chosen pieces, its
    rarest ones there."""
    large = ys.groupBy("key").count().filter(F.col("count") > BLOCK).select("key")
    each = xs.join(large, "key", "left_semi").select("key", F.col("own.id").alias("id"), F.explode("own.pieces").alias("piece"))
    rare = each.join(each.groupBy("key", "piece").count(), ["key", "piece"]).groupBy("key", "id").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "piece"))), 1, threshold + 1).alias("r"))
    rare = rare.select("key", "id", F.transform("r", lambda v: v["piece"]).alias("chosen"))
    none = F.lit(None).cast("array<long>")
    few = xs.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("piece"), F.col("own").withField("chosen", none).alias("own"))
    many = xs.withColumn("id", F.col("own.id")).join(rare, ["key", "id"])
    many = many.select("key", F.explode("chosen").alias("piece"), F.col("own").withField("chosen", F.col("chosen")).alias("own"))
    wanted = many.select("key", "piece").distinct()
    small = ys.join(large, "key", "left_anti").select("key", F.lit(0).cast("long").alias("piece"), "own")
    split = ys.join(large, "key", "left_semi").select("key", F.explode("own.pieces").alias("piece"), "own").join(wanted, ["key", "piece"], "left_semi")
    return in_blocks(few.unionByName(many), "xs").join(in_blocks(small.unionByName(split), "ys"), ["key", "piece"])


def line_links(lines: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """line_id, component (the least line_id reachable), n_links: of the lines that have links."""
    members = written(buckets(lines, threshold, least))
    wanted = members.select(F.col("leader").alias("line_id")).union(members.select("id")).distinct()
    texts = written(lines.select("line_id", "line", "n").join(wanted.hint("merge"), "line_id", "left_semi"))
    text_of = lambda name, to: texts.select(F.col("line_id").alias(name), F.struct("n", "line").alias(to))
    tried = members.select("leader", "id").distinct().join(text_of("leader", "x"), "leader").join(text_of("id", "y"), "id")
    found = tried.filter(within(F.col("x.line"), F.col("x.n"), F.col("y.line"), threshold))
    ordered = (F.col("x.n") < F.col("y.n")) | (F.col("leader") < F.col("id"))
    first = written(found.select("leader", "id", ordered.alias("ordered"), first_key(F.col("x.line"), F.col("x.n"), F.col("y.line"), F.col("y.n"), threshold).alias("key")))
    labels = components(first.select(F.col("leader").alias("a"), F.col("id").alias("b"))).withColumnsRenamed({"node": "line_id"})
    # a pair belongs to its first common bucket: to the leader's trials there, or to the blocks of the others
    led = members.join(first.filter("ordered"), ["key", "leader", "id"], "left_semi")
    several = members.filter("indexed").select("key").distinct()
    met = members.join(several, "key", "left_semi").join(text_of("leader", "x").select("leader", F.col("x.n").alias("n")), "leader")
    met = met.withColumnRenamed("id", "line_id").join(texts.withColumnRenamed("n", "m"), "line_id").join(labels, "line_id", "left")
    own = [F.col("line_id").alias("id"), F.col("m").alias("n"), "line", F.coalesce("component", "line_id").alias("component")]
    met = written(met.repartition("key", "line_id").select("key", "indexed", F.struct(*own, pieces(F.col("line"), F.col("n"), threshold, threshold).alias("pieces")).alias("own")))
    put = F.struct("own.id", "own.n", "own.line", "own.component", pieces(F.col("own.line"), F.col("own.n"), threshold, 0).alias("pieces"))
    both = meetings(met.filter("indexed").select("key", put.alias("own")), met.select("key", "own"), threshold)
    both = both.repartition("key", "piece", "xs_block", "ys_block")

    def linked(x: Column, y: Column) -> Column:
        ordered = (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["id"] < y["id"]))
        alike = F.size(F.array_intersect(x["pieces"], y["pieces"])) >= n_pieces(threshold) - threshold
        first = x["chosen"].isNull() | (F.array_min(F.array_intersect(x["chosen"], y["pieces"])) == F.col("piece"))
        here = first_key(x["line"], x["n"], y["line"], y["n"], threshold) == F.col("key")
        return ordered & first & alike & here & (edit_distance(x["line"], y["line"], threshold) <= threshold)

    pair = lambda x, y: F.struct(x["id"].alias("a"), y["id"].alias("b"), F.least(x["component"], y["component"]).alias("p"), F.greatest(x["component"], y["component"]).alias("q"))
    pairs = F.flatten(F.transform("xs", lambda x: F.transform(F.filter("ys", lambda y: linked(x, y)), lambda y: pair(x, y))))
    blocks = both.select(pairs.alias("pairs"))  # no filter here: it would be moved before the exchange, with all its work
    ends = F.concat(F.transform("pairs", lambda v: v["a"]), F.transform("pairs", lambda v: v["b"]))
    count = lambda v: F.struct(v.alias("line_id"), F.size(F.filter("pairs", lambda p: (p["a"] == v) | (p["b"] == v))).alias("n"))
    joins = F.array_distinct(F.transform(F.filter("pairs", lambda p: p["p"] != p["q"]), lambda p: F.struct(p["p"].alias("a"), p["q"].alias("b"))))
    sums = written(blocks.select(F.transform(F.array_distinct(ends), count).alias("counts"), joins.alias("joins")))
    degree = sums.select(F.explode("counts").alias("c")).select("c.line_id", "c.n").unionByName(
        led.select(F.explode(F.array("leader", "id")).alias("line_id"), F.lit(1).alias("n"))
    ).groupBy("line_id").agg(F.sum("n").alias("n_links"))
    more = components(sums.select(F.explode("joins").alias("j")).select("j.a", "j.b").distinct())
    renamed = more.select(F.col("node").alias("component"), F.col("component").alias("final"))
    out = degree.join(labels, "line_id", "left").withColumn("component", F.coalesce("component", "line_id")).join(renamed, "component", "left")
    out = written(out.select("line_id", F.coalesce("final", "component").alias("component"), "n_links"))
    for used in (members, texts, first, met, sums):
        unwritten(used)
    return out


def line_report(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """One row per distinct line: line_md5, first_doc_id, n_copies, n_links, class_md5 and class_doc_id
    (of its class's line with the least md5, and the least id in the class)."""
    lines = distinct_lines(docs)
    own = lines.select("line_id", F.md5(F.col("line").cast("binary")).alias("line_md5"), "first_doc_id", "n_copies")
    linked = own.drop("n_copies").join(line_links(lines, threshold, least).hint("merge"), "line_id")
    no_id = F.max(F.col("first_doc_id").isNull())
    heads = linked.groupBy("component").agg(F.min("line_md5").alias("class_md5"), F.when(~no_id, F.min("first_doc_id")).alias("class_doc_id"))
    linked = linked.join(heads, "component").select("line_id", "n_links", "class_md5", "class_doc_id")
    return own.join(linked.hint("merge"), "line_id", "left").select(
        "line_md5",
        "first_doc_id",
        "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_md5", "line_md5").alias("class_md5"),
        F.when(F.col("class_md5").isNull(), F.col("first_doc_id")).otherwise(F.col("class_doc_id")).alias("class_doc_id"),
    )


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, least: int = LEAST) -> DataFrame:
    """docs with only the first line of each class left in the texts. Lines are in the order of their
    document's id (null first), the row's place in the table, and the line's place in the text, so rows
    of one id, or without one, keep texts of their own. Every row stays, with its blank lines."""
    names = docs.columns
    row, rest = fresh(names, "row"), fresh(names, "rest")
    placed = written(docs.withColumn(row, F.monotonically_increasing_id()))
    rows = placed.select("doc_id", "text", F.col(f"`{row}`").alias("row"))
    lines = distinct_lines(rows)
    named = lines.select("line", "line_id").join(line_links(lines, threshold, least), "line_id", "left").select("line", F.coalesce("component", "line_id").alias("class"))
    at = F.struct("doc_id", "row", "line_no")
    first = lines_of(rows, "doc_id", "row").join(named, "line").groupBy("class").agg(F.min(at).alias("at")).select("at.row", "at.line_no", F.lit(True).alias("stays"))
    cut = rows.select("row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kept = cut.join(first, ["row", "line_no"], "left").filter(F.col("stays") | ~F.col("line").rlike(r"\S"))
    text = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x")).select(F.col("row").alias(row), F.array_join("x.line", "\n").alias(rest))
    text_of = F.when(F.col("text").isNotNull(), F.coalesce(F.col(f"`{rest}`"), F.lit("")))
    return placed.join(text, row, "left").withColumn("text", text_of).select(*(F.col(f"`{c}`") for c in names))


#: DuckDB's levenshtein counts bytes, so the letters outside ASCII that the tables have stand for one byte each there.
LETTERS = "ÄÖÜßäöüÉÈÊÇéèêçÓÍÑóíñáúâàîô"
PLAIN = " || ".join(f"chr({n})" for n in [*range(1, 9), *range(14, 32), 127])
ORACLE_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT line, min(doc_id) AS first_doc_id, count(*) AS n_copies
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY 1
), m AS (SELECT *, md5(line) AS h, length(line) AS n, translate(line, '{LETTERS}', {PLAIN}) AS plain FROM l
), links AS (
  SELECT a.h AS a, b.h AS b FROM m a JOIN m b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.h <> b.h AND levenshtein(a.plain, b.plain) <= 2
), reach AS (SELECT a AS h, b FROM links UNION SELECT r.h, k.b FROM reach r JOIN links k ON r.b = k.a
), class AS (SELECT r.h, min(x.h) AS class_md5, min(x.first_doc_id) AS class_doc_id FROM reach r JOIN m x ON x.h = r.b GROUP BY 1)
SELECT h AS line_md5, first_doc_id, n_copies, (SELECT count(*) FROM links WHERE a = h) AS n_links,
       least(h, coalesce(class_md5, h)) AS class_md5, least(first_doc_id, coalesce(class_doc_id, first_doc_id)) AS class_doc_id
FROM m LEFT JOIN class USING (h)
"""
