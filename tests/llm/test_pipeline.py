"""The pipeline's stages one after the other, each held against what its operator promises."""

from collections import Counter

import corpus_pipeline


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, sf_dir))
        assert after.columns == columns
        old, new = Counter(r["doc_id"] for r in before.collect()), Counter(r["doc_id"] for r in after.collect())
        assert new and set(new) <= set(old), name
        if name == "exact_dedup":
            texts = [r["text"] for r in after.collect()]
            assert len(texts) == len(set(texts)) == before.select("text").distinct().count()
        if name == "mixing":
            assert max(new.values()) <= 3
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert pieces.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash", "mixing", "packing"]


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_odd_rows(spark, sf_dir):
    """Nulls, repeated rows and ids, long texts and clashing names; one row of each distinct text stays."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [(None, "one plain text of a few words"), (None, "quite another text with other words"), (7, "one plain text of a few words"), (7, "one plain text of a few words"), (8, None), (None, ""), (9, long), (10, long + " end")]
    docs = spark.createDataFrame([(i, t, None, "s" if k % 2 else None, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("node", "row", "target", "copies", "keep_id", "component")})
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir))
        seen.append(sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in docs.collect()))
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[-1] == "component"
    a, b = len("one plain text of a few words"), len("quite another text with other words")
    assert seen[0] == sorted((i or 0, len(t or "")) for i, t in texts)
    assert seen[1] == sorted([(7, a), (0, b), (8, 0), (9, len(long)), (10, len(long) + 4)])
    assert seen[2] == sorted([(7, a), (0, b), (8, 0), (9, len(long))])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.agg(F.max("length")).first()[0] <= 4096
