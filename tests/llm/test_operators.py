"""Each operator against brute force on small tables, and its defined results for odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from neurolattice.llm import components as cc
from neurolattice.llm import exact_dedup, lattice_lm, line_dedup, minhash, mixing, packing, sharding, toxicity, url_filter
from neurolattice.llm.queries import QUERIES, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and river stone lamp glass ember cloud sorrow window candle harbor meadow winter silver garden thunder copper violet".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)) + "."


@pytest.fixture(scope="module")
def odd():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = [base.replace("river", "ocean", k) for k in range(1, 6)]
    rows = [
        (1, base, "en", "a", 1), (2, base, None, "a", None), (2, base, None, "a", None), (None, base, "en", None, 3), (None, None, None, None, None),
        (3, None, "en", "b", 0), (4, "", "fr", "b", 0), (5, "  \t\n ", "fr", "c", 5), (6, "Two words", "en", "c", 9), (7, "two WORDS", "en", None, 9),
        (8, prose(rng, 30_000), "de", "a", 1), (9, "x" * 90_000, "de", "c", 1), (10, "naïve Ünïcödé — 漢字 🙂 <|endoftext|> İstanbul", "es", "b", 1),
    ]
    rows += [(20 + k, t, "en", "c", 1) for k, t in enumerate(near)]
    rows += [(40 + k, prose(rng, rng.randint(1, 80)), rng.choice(["en", "fr"]), rng.choice("abc"), 1) for k in range(40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3).persist()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# --- exact deduplication


def test_exact(docs, odd):
    by = defaultdict(list)
    for r in odd:
        by[r[1] or ""].append(r[0])
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(odd)
    for r in got:
        text = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in by[t])
        keep = max((i for i in by[text] if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(by[text]), r["doc_id"] == keep)


def test_exact_filter(docs, odd):
    left = exact_dedup.exact_dedup(docs.withColumnRenamed("source", "keep_id")).collect()
    assert sorted(r["text"] or "" for r in left) == sorted({r[1] or "" for r in odd})
    assert left[0].asDict().keys() == {"doc_id", "text", "lang", "keep_id", "n_chars"}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0 == exact_dedup.exact_groups(docs.limit(0)).count()


def test_chunks_follow_content():
    rng = random.Random(1)
    a, b = rng.randbytes(60_000), rng.randbytes(30_000)
    import pyarrow as pa

    texts = [x.hex() for x in (a, b + a, a)]
    (_, first), (_, moved), (_, again) = exact_dedup.chunked(pa.array(texts))
    assert [bytes(c) for c in first] == [bytes(c) for c in again]
    assert len({bytes(c) for c in first} & {bytes(c) for c in moved}) > 0.9 * len(first)
    assert b"".join(first) == texts[0].encode() and max(map(len, moved)) <= exact_dedup.MOST


def test_chunk_store(docs, odd):
    store = exact_dedup.chunk_store(docs).collect()
    assert all(exact_dedup.recipe([bytes(r["content"])]) == bytes(r["digest"]) for r in store) and len(store) == len({bytes(r["content"]) for r in store})
    assert sum(len(r["content"]) * r["n_uses"] for r in store) == sum(len((r[1] or "").encode()) for r in odd)


def test_exact_filter_keeps_one_of_equal_rows(spark):
    rows = [(None, "a", 1), (2, "a", 2), (2, "a", 3), (None, None, 4), (None, "", 5), (1, "b", 6)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string, row long")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (1, "b"), (2, "a")]


# --- near duplicates


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_groups(rows):
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(shingles(r[1]))
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    def linked(a, b):
        return any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in ids[a] for y in ids[b])

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)), key=lambda i: (i is not None, i or 0))
            up[y] = x
    return {i: root(i) for i in ids}


def test_near(docs, odd):
    want = brute_groups(odd)
    got = minhash.near_groups(docs).collect()
    assert len(got) == len(odd)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert {r["n_shingles"] for r in got if r["doc_id"] == 6} == {1} and {r["n_shingles"] for r in got if r["doc_id"] == 5} == {0}
    left = minhash.near_dedup(docs.withColumnRenamed("source", "node")).collect()
    assert Counter(r["doc_id"] for r in left) == Counter({i for i, c in want.items() if i == c})
    assert minhash.near_groups(docs.limit(0)).count() == 0 == minhash.near_dedup(docs.limit(0)).count()


def test_chains_without_a_hub(spark):
    """Texts that are linked only to the next one, and a crowd that shares a passage but is not linked."""
    rng = random.Random(7)
    w = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(w[8 * k : 8 * k + 100]), None, None, None) for k in range(20)]
    passage = prose(rng, 40)
    rows += [(100 + k, passage + " " + " ".join(f"u{k}_{i}" for i in range(rng.randint(20, 60))), None, None, None) for k in range(60)]
    want = brute_groups(rows)
    assert len({want[k] for k in range(20)}) == 1
    got = minhash.near_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_ids_do_not_link(spark):
    """Different texts under a null or a repeated id stay, and so does what is near to none that stays."""
    rng = random.Random(11)
    texts = [prose(rng, 60) for _ in range(8)]
    near = texts[1].replace("river", "ocean", 1)
    rows = [(None, t) for t in texts[:4]] + [(None, near), (7, texts[4]), (7, texts[5]), (8, texts[6]), (8, texts[0]), (9, texts[7]), (9, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert 4 * len(shingles(texts[1]) & shingles(near)) >= 3 * len(shingles(texts[1]) | shingles(near)) and near != texts[1]
    left = Counter(tuple(r) for r in minhash.near_dedup(df).collect())
    assert left[(None, texts[1])] + left[(None, near)] == 1
    assert {k: n for k, n in left.items() if k[1] not in (texts[1], near)} == {(i, t): 1 for i, t in rows if t not in (texts[1], near) and (i, t) != (8, texts[0])}
    got = minhash.near_groups(df).collect()
    assert len(got) == len(rows) and Counter(r["component_id"] for r in got) == {None: 6, 7: 2, 8: 1, 9: 2}


def test_signature_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[500:3500])
    share = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(share - 2500 / 3500) < 0.12


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        return i if up[i] == i else root(up[i])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges if e[0] != e[1] for i in e}


# --- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    rng = random.Random(4)
    base = [prose(rng, 6) for _ in range(12)]
    lines = list(base)
    for line in base:
        for _ in range(6):
            t = list(line)
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(t))
                rng.choice([lambda: t.insert(i, "q"), lambda: t.pop(i), lambda: t.__setitem__(i, "é")])()
            lines.append("".join(t))
    lines += ["short", "shirt", "", "   "]
    rows = [(k // 5, "\n".join(lines[k : k + 5] + lines[:1])) for k in range(0, len(lines), 5)] + [(None, None), (77, ""), (3, lines[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = sorted({x for _, t in rows if t is not None for x in t.split("\n") if x.strip()})
    want = {x: {y for y in own if y != x and len(x) >= 16 <= len(y) and distance(x, y) <= 2} for x in own}
    copies = Counter(x for _, t in rows if t is not None for x in t.split("\n"))
    got = {r["line_md5"]: r for r in line_dedup.line_report(df).collect()}
    assert len(got) == len(own)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for x in own:
        seen, todo = {x}, [x]
        while todo:
            for y in want[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        r = got[md5(x)]
        assert (r["n_links"], r["n_copies"], r["class_md5"]) == (len(want[x]), copies[x], min(map(md5, seen)))
    assert line_dedup.line_report(df.limit(0)).count() == 0
    left = line_dedup.dedup_lines(df.filter("doc_id IS NOT NULL AND doc_id <> 3").withColumn("line", df.doc_id)).collect()
    kept = Counter(x for r in left for x in r["text"].split("\n") if x.strip())
    assert max(kept.values()) == 1 and len(left) == len({r[0] for r in rows if r[0] not in (None, 3)})


def test_short_lines(spark, tmp_path):
    """The query links lines of every length."""
    own = ["Read more", "Read more.", "Page 1 of 9", "Page 2 of 9", "a", "b", "cd", "xyz", "xyzw", "cdef", "ef", "é🙂", "five6", "fifteen letters", "fifteen letters!", "other words that stand alone", "qqq", "rrrrr"]
    spark.createDataFrame([(k, x) for k, x in enumerate(own)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["first_doc_id"]: r["n_links"] for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {k: sum(distance(x, y) <= 2 for y in own) - 1 for k, x in enumerate(own)}


# --- mixing


def test_targets():
    got = mixing.targets([100, 100, 1000, 0], [1, 2, 3, 1])
    assert got == [pytest.approx(x) for x in (225.0, 300.0, 675.0, 0.0)]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]


def test_route_is_cheapest():
    """Against every split of small capacities: most flow first, then the least repetition cost."""
    rng = random.Random(6)
    for _ in range(25):
        cap = [rng.randint(1, 3) for _ in range(3)]
        members = [[0], [0, 1], [1]]
        quota = [rng.randint(0, 7), rng.randint(0, 7)]
        best = None
        for g in itertools.product(*(range(3 * c + 1) for c in cap)):
            for x in range(g[1] + 1):
                if g[0] + x <= quota[0] and g[2] + g[1] - x <= quota[1]:
                    cost = sum(sum((i // c) + 1 for i in range(v)) for v, c in zip(g, cap))
                    best = max(best or (-1, 0), (sum(g), -cost))
        got = mixing.route(cap, members, quota)
        assert (sum(got), -sum(sum((i // c) + 1 for i in range(v)) for v, c in zip(got, cap))) == best


def test_mix(docs, odd):
    got = mixing.mix_report(docs).collect()
    sizes = Counter()
    for r in odd:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [1, 2, 3, 1])))
    assert len(got) == len(odd) and sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] or 0, len(words(r[1]))) for r in odd)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {(r["source_size"], round(r["target"], 6)) for r in got} == {(sizes[s], round(want[s], 6)) for s in order}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=str)
    assert mixing.mix_report(docs.limit(0)).count() == 0 == mixing.mix_documents(docs.limit(0)).count()
    out = mixing.mix_documents(docs.withColumnRenamed("n_chars", "size"))
    assert out.columns == ["doc_id", "text", "lang", "source", "size"] and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix_documents(docs.withColumnsRenamed({"n_chars": "copies", "lang": "target"})).columns == ["doc_id", "text", "target", "source", "copies"]


def test_mix_without_membership(spark):
    from pyspark.sql import functions as F

    rows = [(k, "a b c", "en", None if k % 3 == 0 else "x", k) for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    given = F.when(F.col("n_chars") % 3 == 0, F.lit(None)).when(F.col("n_chars") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("x")))
    taken = Counter(r["doc_id"] for r in mixing.mix_documents(df, given).collect())
    assert sum(taken.values()) > 20 and max(taken.values()) <= 3 and {k % 3 for k in taken} == {0, 1, 2}


def test_mix_is_near_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), "en", f"s{min(5, rng.randrange(12))}", 1) for k in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken, target = Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in mixing.mix_report(df).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 0.002 * target[s] + 3 for s in target)


@pytest.mark.parametrize("fine", [mixing.FINE, 3])
def test_mix_goes_on_after_a_long_document(spark, monkeypatch, fine):
    """No document that would still fit is left out of a source that is under its target."""
    monkeypatch.setattr(mixing, "FINE", fine)
    rng = random.Random(5)
    rows = [(k, "w " * (rng.randint(1, 20) if k % 5 else 10), "en", f"s{k % 6}", 1) for k in range(3000)]
    rows += [(9000 + k, "w " * 20_000, "en", f"s{k % 6}", 1) for k in range(6)]
    source = {r[0]: r[3] for r in rows}
    taken, target, out, full = Counter(), {}, defaultdict(list), Counter()
    got = mixing.mix_report(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s] = r["target"]
        full[s] = max(full[s], r["copies"])
    for r in got:
        if r["copies"] < full[source[r["doc_id"]]]:
            out[source[r["doc_id"]]].append(r["size"])
    assert sum(20_000 in out[s] and len(out[s]) > 1 for s in out) >= 1  # a long document is left out on the way
    assert all(-1 <= target[s] - taken[s] <= min(out[s], default=0) for s in target)


def test_overlapping_sources(spark):
    from pyspark.sql import functions as F

    rows = [(k, "w " * 10, "en", "abc"[k % 3], 1) for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.col("source"))).otherwise(F.array("source"))
    assert 0 < mixing.mix_documents(df, both).count() <= 270


# --- line distance


def test_banded_distance(spark):
    from pyspark.sql import functions as F

    rng, pairs = random.Random(3), []
    for _ in range(800):
        x = [rng.choice("ab é😀") for _ in range(rng.randrange(1, rng.choice([4, 30])))]
        y = x[:]
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(2)] = [rng.choice("abc")] * rng.randrange(2)
        x, y = sorted((x, y), key=len)
        if x and len(y) - len(x) <= 3:
            pairs.append(("".join(x), "".join(y)))
    long = "".join(rng.choice("abcdef") for _ in range(100_000))
    pairs += [(long, long), (long, long[:70_000] + "zz" + long[70_000:]), (long[1:] + "zz", "z" + long + "y")]
    df = spark.createDataFrame(pairs, "x string, y string")
    for k in (2, 3):
        near = df.filter(F.length("y") - F.length("x") <= k)
        got = near.select(line_dedup.edit_distance(F.col("x"), F.col("y"), k).alias("own"), F.levenshtein("x", "y", k).alias("want"), line_dedup.may_link(F.col("x"), F.length("x"), F.col("y"), k).alias("may")).collect()
        assert all((r["own"] if r["own"] <= k else -1) == r["want"] and (r["may"] or r["want"] < 0) for r in got)


def test_dedup_lines_keeps_rows_of_one_id_apart(spark):
    rows = [(None, "first line here\nshared line of text", 1), (3, "shared line of text\nown line of three", 2), (3, "another row of three\n\nshared line of text!", 3), (None, None, 4), (5, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    got = {r["row"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: "first line here\nshared line of text", 2: "own line of three", 3: "another row of three\n", 4: None, 5: ""}


# --- language model


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4, "ba": 5, "▁ab": 6}
    weights = np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.1])
    lattice = lattice_lm.Lattice(pieces, {i: 0 for i in range(256)}, 3, [weights])

    def total(s):
        return 1.0 if not s else sum(weights[pieces[s[:n]]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces)

    for word in ("a", "ab", "abab", "babaab"):
        assert math.isclose(math.exp(lattice.score(lattice.edges(word), 0)), total("▁" + word))
        assert np.allclose(np.exp(lattice.many([word, word])), total("▁" + word))
        short, long = np.zeros((1, 7)), np.zeros(7)
        lattice.expect_many([word], np.array([[3]]), short)
        lattice._expect_long(lattice.edges(word), 0, long)
        assert np.allclose(short[0], long) and long[0] + long[4] + long[6] == pytest.approx(1)
    odd = "aéb漢"  # characters that are no pieces are their bytes
    assert np.allclose(lattice.many([odd]), lattice.score(lattice.edges(odd), 0))
    one, other = np.zeros((1, 7)), np.zeros(7)
    lattice.expect_many([odd], np.array([[1]]), one)
    lattice._expect_long(lattice.edges(odd), 0, other)
    assert np.allclose(one[0], other)


def test_lm(docs, odd):
    got = lattice_lm.score_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect()
    counts, n_train = Counter(), 0
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 1
    for r in odd:
        if not held(r[0]):
            counts.update([*words(r[1]), None])
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), held(r[0]), len(words(r[1])) + 1, sum(counts[w] > 0 for w in [*words(r[1]), None]), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*words(r[1]), None]), 4)) for r in odd)
    assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert lattice_lm.score_documents(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_lm_beats_the_base_on_held_out(spark, sf_dir):
    """With enough training text; the base gives all unseen words together what the lattice divides among them."""
    from pyspark.sql import functions as F

    got = lattice_lm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
    r = got.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_lattice_scores_are_a_brute_force_sum(spark):
    """lattice_score from the fitted pieces, by the sum over all segmentations of each word."""
    pieces = lattice_lm.Pieces(tokenizer_path("piece_bpe_32k.model"))
    rows = [(k, t, "en") for k, t in enumerate(["ab abc", "abc", "", "ab\tcab", None, "abc ab", "ab"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = Counter(w for k, t, _ in rows if zlib.crc32(str(k).encode()) % 5 != 1 for w in words(t))
    table = spark.createDataFrame([(w.encode(), n) for w, n in counts.items()], "word binary, n0 long")
    (share,) = lattice_lm.fitted(table, pieces, 1)

    def total(s):
        return 1.0 if not s else sum(share[pieces.number[s[:n]]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in pieces.number)

    n_train, docs_train = sum(counts.values()), sum(zlib.crc32(str(k).encode()) % 5 != 1 for k, _, _ in rows)
    end = (docs_train + 0.5) / (n_train + docs_train + 1)
    for r in lattice_lm.score_documents(docs, tokenizer_path("piece_bpe_32k.model")).collect():
        want = math.log10(end) + sum(math.log10(total("\u2581" + w) * (1 - end)) for w in words(rows[r["doc_id"]][1]))
        assert r["lattice_score"] == pytest.approx(want, rel=1e-5)


# --- sharding


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    for slots in (7, 101, 1009):
        own = sharding.lookup_table(shards, slots)
        counts = Counter(own)
        assert len(own) == slots and max(counts.values()) - min(counts.values()) <= 1
    names = lambda s, n: [s[i] for i in sharding.lookup_table(s, n)]
    a, b = names(shards, 1009), names(shards[:-1], 1009)
    moved = sum(x != y for x, y in zip(a, b) if x != "s6")
    assert moved < 0.25 * 1009
    order = {}
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % 101, int.from_bytes(d[8:16], "big") % 100 + 1
        order[s] = [(at + k * step) % 101 for k in range(101)]
    want, turn = {}, 0
    while len(want) < 101:
        s = shards[turn % 7]
        want[next(x for x in order[s] if x not in want)] = turn % 7
        turn += 1
    assert [want[i] for i in range(101)] == sharding.lookup_table(shards, 101)
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_sharding(docs, odd):
    own = sharding.lookup_table([f"shard-{i:03d}" for i in range(64)])
    got = sharding.shard_documents(docs)
    for r in got.collect():
        slot = int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16) % 65_537
        assert (r["slot"], r["shard"]) == (slot, own[slot])
    assert got.count() == len(odd) and sharding.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(docs.withColumnRenamed("lang", "slot"), [docs.doc_id], ["a"])


# --- toxicity


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [(None, None, None, None, None), (1, "", None, None, None), (1, "", None, None, None)], [(None, 1), (5, None), (7, 1), (7, 0)]
    for k in range(10, 900):
        w = rng.choices(WORDS, k=rng.randint(20, 120))
        bad = k % 7 == 0
        for i in rng.sample(range(len(w)), max(2, len(w) // 30)) if bad else []:
            w[i] = rng.choice(["idiot", "scum###", "zorfle" + rng.choice("abcde"), "MORON!!"])
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, int(bad)))
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = dict(labels[4:])
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    left = toxicity.drop_toxic(df.withColumnRenamed("source", "score"), lab)
    assert left.columns == ["doc_id", "text", "lang", "score", "n_chars"] and left.count() == sum(not r["predicted"] for r in got)
    assert toxicity.score_documents(df.limit(0), lab).count() == 0
    assert toxicity.score_documents(df.limit(50), lab.limit(0)).count() == 50


# --- packing


def test_pieces():
    for n in [*range(1, 300), 1365, 4095, 4096, 4097, 12_345]:
        cut = packing.pieces(n)
        assert sum(x for x, _ in cut) == n and all(x * i <= 4096 and 4096 - x * i < 64 for x, i in cut) and len(cut) <= n // 4096 + 6


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs.withColumnRenamed("n_chars", "start"), path).collect()
    ids = defaultdict(list)
    for r in odd:
        ids[r[0]].append(np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    for doc_id, texts in ids.items():
        own = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc_id)
        assert sum(n * k[1] for k, n in own.items()) == sum(map(len, texts))
        for start, length, crc, total in own:
            assert any(len(t) == total and zlib.crc32(t[start : start + length].tobytes()) == crc for t in texts)
    padding, tokens = 0, 0
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        tokens += at
    assert padding < 0.016 * tokens + 64 and packing.pack(docs.limit(0), path).count() == 0


# --- URLs


def test_urls(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG/", "https://x.Example.org/en/12?q#f", "http://example.org/es/", "http://notexample.org/es/", "http://org", "a://b://c.com/fr/x", "http://é.com/de/", "http://x.com?/fr/", "http://..org/"]
    urls += ["http://" + ".".join(rng.choices(["a", "example", "org", "com"], k=rng.randint(1, 4))) + rng.choice(["", "/", "/fr/1", "/de/2", "/es/", "/en/1x", "/en/2"]) for _ in range(300)]
    rows = [(k if k != 3 else None, u, "h") for k, u in enumerate(urls)] + [(7, urls[7], None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    for r in url_filter.judge_urls(df).collect():
        u = urls[r["page_id"] if r["page_id"] is not None else 3]
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u or "", re.S)
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, best[1], best[2])
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_digests_survive_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    path = tmp_path / "rules"
    path.write_bytes(url_filter.Digests.build(url_filter.RULES))
    d = url_filter.Digests(str(path))
    assert d.judge(["http://example.org/es/1"])[0][2:] == ("example.org/es/", "block") and d.judge(["http://sample.com/zz/"])[0][2:] == (None, "allow")
    with pytest.raises(ValueError):
        url_filter.Digests.build([("a", "/", "allow"), ("a", "/", "block")])


def test_verified_deals_a_large_head_to_blocks(spark):
    """A head of more pairs than a block holds, beside small ones: every pair is tried once."""
    many = 2 * minhash.BLOCK + 100
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(0, text), *((i, f"{text} x{i}" if i % 3 else f"other words {i} entirely as they stand") for i in range(1, many)), (many, "a b c d e f"), (many + 1, "a b c d e f")]
    pairs = [(0, i) for i in range(1, many)] + [(many, many + 1)]
    found = minhash.verified(spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(docs, "node long, text string"), 75).collect()
    assert sorted(map(tuple, found)) == sorted([(0, i) for i in range(1, many) if i % 3] + [(many, many + 1)])


def test_near_dedup_ties_are_the_same_in_every_order(spark):
    rows = [(1, "one two three four five six", f"v{i}", i) for i in range(6)]
    kept = [minhash.near_dedup(spark.createDataFrame(order, "doc_id long, text string, node string, number long").repartition(3)).collect() for order in (rows, rows[::-1])]
    assert len(kept[0]) == 1 and kept[0] == kept[1]
