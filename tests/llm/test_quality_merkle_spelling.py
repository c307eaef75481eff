"""Nearest-neighbour quality, the Merkle manifest and spelling variants, against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from neurolattice.llm import merkle, neighbours, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def same(spark, operator, sql, rows, schema=SCHEMA):
    """The operator's rows are those of the SQL."""
    df = spark.createDataFrame(rows, schema)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    got = operator(df.repartition(5))
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    return Counter(tuple(r) for r in got.select(want.columns).collect()) == Counter(want.fetchall())


# --- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form, met = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(w, v)]
        met[w] = len(others)
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, met[w], counts.get(form[w])))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    base = ["lantern", "lanterns", "mmountain", "mountain", "pelican", "pelicans", "çedillaß", "riverbed", "riverbend", "bookkeeper"]
    rows = []
    for k in range(300):
        said = []
        for w in rng.choices(base, weights=[60, 3, 2, 40, 30, 1, 5, 20, 2, 9], k=12):
            if rng.random() < 0.08:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("aeéz") + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at:]])
            said.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, rng.choice([" ", ", ", "1", "·"]).join(said), "en", "a", 1))
    long = "ab" * 3_000
    rows += [(None, "lantern pelican İİİİİİİİ ÀÁÂÃÄÅÆÇ", None, None, None), (7, None, "en", "a", 0), (8, "", "en", "a", 0), (9, "Lantern " * 40_000, "en", "b", 1)]
    rows += [(k, f"{long} {long[:-1]}c {long}c", "en", "c", 1) for k in (1_000, 1_000, 1_001, 1_002)]
    return rows


def test_spelling(spark, spelled):
    df = spark.createDataFrame(spelled, SCHEMA).withColumnRenamed("source", "word").withColumnRenamed("n_chars", "n").repartition(4)
    got = [tuple(r) for r in spelling.spelling_variants(df).collect()]
    want = brute_spelling(spelled)
    assert len(got) == len(want) and set(got) == want
    assert sum(f is not None for _, f, *_ in want) > 30


def test_spelling_sql(spark, spelled):
    assert same(spark, spelling.spelling_variants, spelling.ORACLE_SQL, spelled[:304])


def test_spelling_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).count() == 0


def test_chain_of_forms(spark):
    words = [(k, w, n) for k, (w, n) in enumerate([("aaaaaaa", 20_000), ("aaaaaab", 1_500), ("aaaaabb", 120), ("aaaabbb", 9), ("zzzzzzz", 5)])]
    got = {r["word"]: (r["form"], r["root"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(words, "id long, word string, n long")).collect()}
    assert got["aaaabbb"] == ("aaaaabb", "aaaaaaa", 1, 120) and got["aaaaaab"] == ("aaaaaaa", "aaaaaaa", 2, 20_000)
    assert got["aaaaaaa"] == (None, "aaaaaaa", 1, None) and got["zzzzzzz"] == (None, "zzzzzzz", 0, None)


# --- Merkle manifest


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        at = i // 8 * 8
        out.append((level[at:i], level[i + 1 : at + 8]))
        i //= 8
    return out


def brute_merkle(rows):
    def leaf(d, t, g, s, n):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t)))

    by = defaultdict(list)
    for d, t, g, s, n in rows:
        own = leaf(d, t, g, s, n)
        picked = zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 0 and t is not None
        by[g].append((d is not None, d or 0, own, leaf(d, lower(t), g, s, n) if picked else own, d))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g], key=lambda x: x[:4])]) for g in groups}
    top = tree([trees[g][-1][0] for g in groups])
    for k, g in enumerate(groups):
        for i, x in enumerate(sorted(by[g], key=lambda x: x[:4])):
            path, folded = proof(trees[g], i) + proof(top, k), x[3]
            for before, after in path:
                folded = digest(*before, folded, *after)
            yield x[4], x[2], trees[g][-1][0], top[-1][0], digest(*(y for a, b in path for y in a + b)), folded, folded == top[-1][0]


@pytest.fixture(scope="module")
def hashed():
    rng = random.Random(2)
    rows = [(k, f"Text {k} " * rng.randint(0, 9), "en", rng.choice(["a", None]), k) for k in rng.sample(range(10**6), 700)]
    rows += [(k, "Ä" * k, f"g{k % 23}", "ß", None) for k in range(60)] + [(5, "same", "fr", "s", 1)] * 20 + [(5, "Other", "fr", "s", 1), (None, "x", "fr", None, None)]
    return rows + [(None, None, None, None, None), (None, "A", None, "", 0), (1, "", "", "", 0), (-3, "Z" * 100_000, "zz", "-", -1)]


@pytest.mark.parametrize("parts", [1, 4, 60])
def test_merkle(spark, hashed, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in merkle.audit(spark.createDataFrame(hashed, SCHEMA).repartition(3)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(got) == Counter(brute_merkle(hashed))


def test_merkle_sql(spark, hashed):
    assert same(spark, merkle.audit, merkle.ORACLE_SQL, hashed)


@pytest.mark.parametrize("n", [0, 1, 8, 9, 64, 65])
def test_merkle_sizes(spark, n):
    rows = [(k, "T", "en", "s", 1) for k in range(n)]
    assert Counter(tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA)).collect()) == Counter(brute_merkle(rows))


def test_manifest_proofs(spark):
    """The general operator: any group, key and leaf; a proof leads from a leaf to the root, and from no other."""
    from pyspark.sql import functions as F

    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3).cast("string").alias("shard"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = merkle.manifest(rows, "shard", "key", "h")
    assert got.filter(merkle.folded(F.col("h"), F.col("proof")) != F.col("root")).count() == 0
    assert got.filter(merkle.folded(F.sha2("h", 256), F.col("proof")) == F.col("root")).count() == 0
    assert got.select("root").distinct().count() == 1 and got.select("subroot").distinct().count() == 3


def test_spans():
    # groups a, a | a b c | c | c d
    assert merkle.spans([(0, 1, "a", 2, "a", 2), (1, 3, "a", 1, "c", 4), (3, 1, "c", 5, "c", 5), (4, 2, "c", 1, "d", 7)]) == {0: (0, 3, 3), 1: (2, 3, 10), 3: (4, 10, 10), 4: (9, 10, 7)}


# --- nearest-neighbour quality


def table(rng, n):
    words = "the of and river stone lamp glass ember cloud sorrow window candle harbor meadow winter silver".split()
    rows, labels = [], []
    for k in range(n):
        good, w = k % 3 != 0, rng.choices(words, k=rng.randint(20, 90))
        rows.append((k, " ".join(w) + "." if good else " ".join(x.upper() + "!!" if rng.random() < 0.8 else x for x in w), "en", "a", 1))
        labels.append((k, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def rated(spark):
    rows, labels = table(random.Random(4), 240)
    rows += [(None, None, None, None, None), (1_000, "", "en", "a", 0), (1_001, "word " * 120_000, "en", "b", 1), (3, rows[3][1], "en", "a", 1), (3, "other text", "en", "a", 1)]
    labels += [(None, 1, 0), (6, None, 0), (9, 1, 1), (5_000, 1, 0)]
    return rows, labels, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(rated):
    rows, labels, docs, own = rated
    got = neighbours.score_documents(docs, own).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 1) for r in got)
    truth = {k: k % 3 != 0 for k in range(240)}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth.keys() - {3}]
    assert len(held) > 50 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_quality_votes_are_exact(rated):
    """The vote of a block is that of each text by itself, from all cosines, sorted."""
    *_, docs, own = rated
    v = neighbours.trained(docs, own, neighbours.teaches())
    texts = [r["text"].encode() for r in docs.filter("doc_id < 40").collect()]
    z = v.place(texts, neighbours.Memo(neighbours.of_word))
    got = v.vote(z)
    for k in range(len(texts)):
        cos = [float(np.dot(z[k], x)) for x in v.vectors]
        last = sorted(cos, reverse=True)[v.nearest - 1]
        use = [(max(0, min(1, c)) ** v.power, y) for c, y in zip(cos, v.labels, strict=True) if c >= last - 1e-6]
        assert abs(got[k] - (sum(w * y for w, y in use) + 0.01 * v.mean) / (sum(w for w, _ in use) + 0.01)) < 1e-4
    taught = {k for k, q, _ in rated[1] if k is not None and q is not None and zlib.crc32(str(k).encode()) % 3 != 1 and k < 240} - {9}
    assert len(v.labels) == len(taught)


def test_space_is_the_leading_one(rated):
    *_, docs, own = rated
    idf = neighbours.frequencies(docs)
    sample = neighbours.sampled(docs, own, "quality", neighbours.teaches(), idf, 1_000)
    rows = [(np.frombuffer(r["terms"], np.int16), np.frombuffer(r["weights"], np.float32)) for r in sample.collect()]
    x = np.zeros((len(rows), neighbours.TERMS))
    for k, (a, w) in enumerate(rows):
        x[k, a] = w
    best = (np.linalg.svd(x)[1][:8] ** 2).sum()
    assert ((x @ neighbours.space(sample, 8)) ** 2).sum() > 0.995 * best
    assert neighbours.sampled(docs, own, "quality", neighbours.teaches(), idf, 7).count() == 7


def test_idf_over_all(rated):
    rows, _, docs, _ = rated
    df, memo = np.zeros(neighbours.TERMS), neighbours.Memo(neighbours.of_word)
    for r in rows:
        df[neighbours.terms_of((r[1] or "").encode(), memo)[0]] += 1
    assert np.allclose(neighbours.frequencies(docs), np.log((len(rows) + 1) / (df + 1)) + 0.1)


def test_quality_odd(spark, rated):
    *_, docs, own = rated
    assert neighbours.score_documents(docs.limit(0), own).count() == 0
    assert {r["score"] for r in neighbours.score_documents(docs, own.limit(0)).collect()} == {0.5}
    kept = neighbours.keep_good(docs.withColumnRenamed("source", "terms"), own)
    assert kept.columns == ["doc_id", "text", "lang", "terms", "n_chars"]
    ids = {r["doc_id"] for r in kept.collect()}
    assert {k for k in range(240) if k % 3} - {9, 6} <= ids and len(ids & {k for k in range(240) if k % 3 == 0}) <= 2


# --- bounds of earlier operators


def test_toxicity_sample_is_bounded(spark):
    """A labelled id that many rows have teaches once."""
    from neurolattice.llm import toxicity

    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(ids[0], f"text {i % 7}") for i in range(500)] + [(k, f"own {k}") for k in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, toxic int")
    assert toxicity.sampled(docs, labels, 2).count() == 2 and toxicity.sampled(docs, labels, 1_000).count() == len(ids)
    assert toxicity.sampled(docs.filter(f"doc_id = {ids[0]}"), labels, 1_000).collect()[0]["text"].startswith("text ")


def test_toxicity_odd_rows(spark):
    """Very long texts, ties and repeated ids are scored each."""
    from neurolattice.llm import toxicity

    rows = [(1, "you idiot " * 90_000), (2, "a calm day " * 90_000), (2, "a calm day"), (2, "a calm day"), (3, None), (None, "idiot idiot idiot moron")]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert min(r["score"] for r in got if r["doc_id"] in (1, None)) > max(r["score"] for r in got if r["doc_id"] in (2, 3))
    assert len({r["score"] for r in got if r["doc_id"] == 2}) == 1


def test_images_of_too_many_pixels(spark):
    """A short, whole file of many pixels gives null pixels and the reason; others go on."""
    from neurolattice.llm import media, webp

    w = webp.Writer()
    w.put(0x2F, 8)
    for n in (16_383, 16_383):
        w.put(n, 14)
    w.put(0, 1 + 3 + 1)  # no alpha, version, transforms
    w.put(0, 2)  # no cache, one group
    for _ in range(5):
        w.put(1, 1)  # simple code
        w.put(0, 3)  # of one symbol, 0
    bomb = webp.wrapped(w.value.to_bytes(-(-w.n // 8), "little"))
    small = webp.encode_samples(np.zeros((2, 6), np.uint8))
    got = sorted(media.decode_column(spark.createDataFrame([(0, bytearray(bomb)), (1, bytearray(small))], "id long, image binary"), "image").collect(), key=lambda r: r["id"])
    assert got[0]["image_pixels"] is None and "16384 x 16384" in got[0]["image_error"]
    assert (got[1]["image_height"], got[1]["image_width"]) == (2, 2)
    assert "4 are decoded" not in str(media.decode_column(spark.createDataFrame([(1, bytearray(small))], "id long, image binary"), "image", 4).first()["image_error"])
    assert "3 are decoded" in media.decode_column(spark.createDataFrame([(1, bytearray(small))], "id long, image binary"), "image", 3).first()["image_error"]


# --- line dedup: hot segments


def hot_lines(rng, n):
    """Lines that share their last 40 characters and little else, and a few that are near each other."""
    tail = " and all rights to this text are reserved"[:40]
    letters = "abcdefghijklmnopqrstuvwxyz"
    lines = ["".join(rng.choices(letters, k=80)) + tail for _ in range(n)]
    for k in range(0, n - 1, 9):  # two edits away, anywhere
        x = list(lines[k])
        for _ in range(2):
            x[rng.randrange(len(x))] = rng.choice(letters)
        lines[k + 1] = "".join(x)
    for k in range(4, n - 1, 11):
        at = rng.randrange(100)
        lines[k + 1] = lines[k][:at] + "z" + lines[k][at:]
    return lines


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        if min(row) > most:
            return most + 1
    return row[-1]


def test_hot_segment_links(spark):
    """A bucket of several hundred lines: every link is found, once."""
    from neurolattice.llm import line_dedup

    lines = sorted(set(hot_lines(random.Random(12), 260)))
    table = line_dedup.distinct_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    names = {r["line_id"]: r["line"] for r in table.collect()}
    got = {names[r["line_id"]]: (names[r["component"]], r["n_links"]) for r in line_dedup.line_links(table).collect()}
    links = defaultdict(set)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and edits(a, b, 2) <= 2:
                links[a].add(b)
                links[b].add(a)
    assert {k: n for k, (_, n) in got.items()} == {k: len(v) for k, v in links.items()} and len(links) > 50
    for a, others in links.items():
        assert all(got[a][0] == got[b][0] for b in others)


def test_hot_segment_grows_in_proportion(spark, monkeypatch):
    """What meets in a bucket grows with its lines, not with their square."""
    from neurolattice.llm import line_dedup
    from pyspark.sql import functions as F

    sizes, real = [], line_dedup.meetings

    def counted(xs, ys, threshold):
        out = real(xs, ys, threshold)
        sizes.append(out.agg(F.coalesce(F.sum(F.size("xs") + F.size("ys")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(line_dedup, "meetings", counted)
    for n in (200, 800):
        table = line_dedup.distinct_lines(spark.createDataFrame([(1, "\n".join(hot_lines(random.Random(n), n)))], "doc_id long, text string"))
        line_dedup.line_links(table).count()
    assert 0 < sizes[1] < 6 * sizes[0]
