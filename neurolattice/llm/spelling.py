"""Spelling variants: words one edit apart, grouped without pairs.

Vocabulary. Runs of letters of every whole text are counted in the tasks that read them, then by a
shuffle on the word. Words that are kept get numbers in code-point order (a range sort), so later rows
are numbers and one key each.

Groups. A word of L code points gives L rows: its rest without the code point at p. Rows of one rest and
one p are a wildcard group, all of whose words are a replacement apart; a group needs its size and its
two most frequent words only: each member's best other word is the first, or for the first the second.
A rest that is a word itself is an indel apart from every word it came from: the word joins the rows of
its rest, counts them and takes the most frequent, and each of them takes the word. Equal letters side by
side give one rest several times; only the first counts. So everything about a rest is in one run of
sorted rows (at most an alphabet times a word's length), and what goes on is one row for a word and a
group, combined by sums and minima: rows grow with the letters of the vocabulary.

Rests of more than LONG code points are keyed by their SHA-256 behind a sign that is no letter, so a run
of many thousand letters has short rows.

Defined results: null and empty texts have no runs; a null id counts as the empty text in what picks a
deletion; repeated rows count each; ties of frequency go to the smaller word in code-point order; an
empty table gives an empty result; texts and words of any length are read whole; other columns are not
looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC_SQL, crc_sql, each_text, unwritten, written

LEAST_LENGTH, LEAST_COUNT, RATIO, LONG, HELD = 7, 2, 10, 64, 300_000
#: One in so many occurrences (by a hash of id and run) loses a code point.
EVERY = 31
#: A run of letters after A-Z are lower-cased.
LETTERS = "[a-zÀ-ÿ]+"


def counted(texts: Iterator[tuple[object, bytes]], least: int, every: int | None) -> Iterator[Counter]:
    """Counters of words, each of at most HELD and those of one text."""
    runs, counts = re.compile(LETTERS[:-1] + f"{{{least},}}"), Counter()
    for key, text in texts:
        head = b"" if key is None else str(key).encode()
        for run, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes.lower: A-Z only
            if every and (h := zlib.crc32(head + b":" + run.encode())) % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            counts[run] += n
        if len(counts) >= HELD:
            yield counts
            counts = Counter()
    if counts:
        yield counts


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = EVERY) -> DataFrame:
    """id (in code-point order of words), word, n: words of at least least_length code points that occur at
    least least_count times; one in every occurrences has lost a code point (None: none). A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (pair for b in batches for pair in zip(b.column("doc_id").to_pylist(), each_text(b.column("text")), strict=True))
        for counts in counted(texts, least_length, every):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    words = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(words.filter(F.col("n") >= least_count).orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def key(rest: Column) -> Column:
    return F.when(F.length(rest) <= LONG, rest).otherwise(F.concat(F.lit("#"), F.sha2(rest, 256)))


def nearest(words: DataFrame) -> DataFrame:
    """words: id, word, n. For words with any: id, n_near, best (struct of -n and id: the near word of most
    occurrences)."""
    at = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("p"))
    cut = F.concat(F.substr("word", F.lit(1), F.col("p")), F.substr("word", F.col("p") + 2))
    rows = at.select("id", (-F.col("n")).alias("less"), "p", key(cut).alias("rest"), ((F.col("p") == 0) | (F.substr("word", F.col("p") + 1, F.lit(1)) != F.substr("word", F.col("p"), F.lit(1)))).alias("first"))
    rows = rows.union(words.select("id", (-F.col("n")).alias("less"), F.lit(-1).alias("p"), key(F.col("word")).alias("rest"), F.lit(False)))
    # one exchange by the rest and one sort serve both windows
    group, whole, me = Window.partitionBy("rest", "p"), Window.partitionBy("rest"), F.struct("less", "id")
    ranked = group.orderBy("less", "id")
    rows = rows.repartition("rest").select(
        "*", F.count("*").over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("size"),
        F.when(F.row_number().over(ranked) == 1, F.lead(me).over(ranked)).otherwise(F.first(me).over(ranked)).alias("other"))
    rows = rows.select(
        "*", F.min(F.when(F.col("p") < 0, me)).over(whole).alias("word_"), F.count(F.when(F.col("first"), 1)).over(whole).alias("longer"),
        F.min(F.when(F.col("first"), me)).over(whole).alias("best_longer"))
    shorter = F.when(F.col("first"), F.col("word_"))
    own = rows.select(
        "id", F.when(F.col("p") < 0, F.col("longer")).otherwise(F.col("size") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("p") < 0, F.col("best_longer")).otherwise(F.least("other", shorter)).alias("best"))
    return own.filter("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms: id, form_id; a form is RATIO times as frequent, so chains are short and without a ring.
    id, form_id, root_id."""
    current = written(forms.select("id", "form_id", F.col("form_id").alias("root_id")))
    while True:
        up = current.select(F.col("id").alias("root_id"), F.col("root_id").alias("higher"))
        onward = written(current.join(up, "root_id", "left").select("id", "form_id", F.coalesce("higher", "root_id").alias("root_id"), F.col("higher").isNotNull().alias("moved")))
        unwritten(current)
        current = onward
        if current.filter("moved").isEmpty():
            return current


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: id, word, n (of vocabulary). word, n, n_near, form (the near word of most occurrences, if it has
    ratio times the word's), form_n, root (the last of the forms that follow one another, or the word)."""
    met = words.join(nearest(words), "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.id").alias("form_id"))
    met = written(met)
    good = (F.col("form_n") >= ratio * F.col("n")) & F.col("form_id").isNotNull()
    linked = roots(met.filter(good).select("id", "form_id"))
    alone = met.filter(~F.coalesce(good, F.lit(False))).select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", F.lit(None).cast("long").alias("form_n"))
    names = words.select("id", "word")
    named = met.select("id", "word", "n", "n_near", "form_n").join(linked, "id")
    named = named.join(names.toDF("form_id", "form"), "form_id").join(names.toDF("root_id", "root"), "root_id")
    return alone.union(named.select("word", "form", "root", "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of docs (doc_id, text), with their forms and roots."""
    return variants(vocabulary(docs))


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, n, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table WHERE length(run) >= {LEAST_LENGTH}),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS p FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
chosen AS (SELECT b.word, min(x.other COLLATE "C") AS other FROM best b JOIN near x ON x.word = b.word AND x.other_n = b.top GROUP BY b.word),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= {RATIO} * w.n THEN c.other END AS form, CASE WHEN b.top >= {RATIO} * w.n THEN b.top END::BIGINT AS form_n FROM words w LEFT JOIN best b USING (word) LEFT JOIN chosen c USING (word)),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, max_by(root, step) AS root FROM chain GROUP BY word) r USING (word)
"""
