"""Every query with an oracle against DuckDB, and streams, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from neurolattice.plans import registry


def parts(df):
    """Columns that are not floating-point as text, and those that are, in one order of rows: by the texts, then by
    values to three places, so that last digits do not change it."""
    df = df[sorted(df.columns)]
    real = [c for c in df.columns if df[c].map(lambda v: isinstance(v, float)).any() and not df[c].map(lambda v: isinstance(v, str)).any()]
    text = [[str(v) if not (v is None or v is pd.NA or v != v) else "" for v in df[c]] for c in df.columns if c not in real]
    value = df[real].astype(float).to_numpy().reshape(len(df), len(real))
    order = sorted(range(len(df)), key=lambda i: ([t[i] for t in text], [round(v, 3) + 0.0 if v == v else 9e99 for v in value[i]]))
    return [[t[i] for i in order] for t in text], value[order]


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    (a, x), (b, y) = parts(got), parts(want)
    assert a == b
    assert np.isclose(x, y, rtol=1e-6, atol=2e-6, equal_nan=True).all(), (x - y)[~np.isclose(x, y, rtol=1e-6, atol=2e-6, equal_nan=True)][:5]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, sf_dir, duck, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert len(want) > 0
    same(got, want)


@pytest.mark.parametrize("name", ["iir_filter", "psd_multitaper", "sliding_estimator", "generalizing_estimator", "csp", "xdawn", "whiten_evoked", "time_delaying_ridge", "find_bad_channels_lof", "apply_ssp"])
def test_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(df.collect()) > 0


def test_streams(spark, tmp_path):
    from neurolattice.streaming import windows

    for k, rows in enumerate(([(1, 0, 0), (1, 1, 3)], [(1, 2, 3), (1, 1, 9), (1, 3, 5), (2, 0, 1)])):
        spark.createDataFrame(rows, "ch long, samp long, code long").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("ch long, samp long, code long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = windows.onsets(stream).writeStream.format("memory").queryName("onsets").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["samp"], r["prev_id"], r["id"]) for r in spark.table("onsets").collect()} == {(1, 0, 3), (3, 3, 5)}
