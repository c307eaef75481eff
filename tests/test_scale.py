"""Queries and operators on odd rows, and what they do as tables grow."""

import math


def test_optical_density_of_values_as_they_are(spark):
    """the query's SQL takes -ln of each value over the channel's mean; a zero is infinite and not repaired."""
    from neurolattice.operators import channels as C

    rows = [(1, 0, 0.0), (1, 1, 4.0), (1, 2, 2.0), (2, 0, 1.0), (2, 1, 3.0), (3, 0, 0.0), (4, 0, -1.0), (4, 1, 3.0)]
    df = spark.createDataFrame(rows, "ch long, samp long, value double")
    got = {(r.ch, r.samp): r.value for r in C.optical_density(df, repair=False).collect()}
    assert got[1, 0] == math.inf and got[1, 1] == -math.log(2) and got[1, 2] == 0
    assert got[2, 0] == math.log(2) and math.isnan(got[3, 0]) and math.isnan(got[4, 0])
    mended = {(r.ch, r.samp): r.value for r in C.optical_density(df).collect()}
    assert mended[1, 0] == mended[1, 2] == 0 and mended[1, 1] == -math.log(2)


def test_equally_far_rates_take_the_lowest_threshold(spark):
    """9 and 7 windows in 1,003 samples: the median is between both rates, and farther from the lower threshold's by
    a last digit."""
    from pyspark.sql import functions as F

    from neurolattice.operators import beats

    made = [(0, k, 1003, 50 * i, 1.0 + i % 2) for k, many in ((5, 9), (6, 7)) for i in range(many)]
    df = spark.createDataFrame(made, "ch long, k int, n long, samp long, rms double")
    before, beats.candidates = beats.candidates, lambda *_: df
    try:
        got = beats.qrs_detector(df, 100.0).agg(F.count("*")).first()[0]
    finally:
        beats.candidates = before
    assert got == 9


def test_nearest_within_meets_few_points(spark):
    """as by all pairs, on even and clustered points, with copies of places and ties."""
    import numpy as np

    from neurolattice.operators import geometry as G

    rng = np.random.default_rng(0)
    p = np.concatenate([np.round(rng.random((300, 3)) * 4, 1), np.round(rng.random((60, 3)) / 5, 2), np.repeat([[1.0, 1.0, 1.0]], 9, 0), [[30.0, 30.0, 30.0], [31.0, 30.0, 30.0]]])
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    want = {tuple(r) for r in G.nearest(G.within(points, points, 2.05).filter("left <> right"), 3).select("left", "right", "dist", "rank").collect()}
    got = [tuple(r) for r in G.nearest_within(points, 3, 2.05).select("left", "right", "dist", "rank").collect()]
    assert set(got) == want and len(got) == len(want)


def test_stc_near_sensors_meets_sensors_only(spark, sf_dir, monkeypatch):
    """points without values are no sensors, so pairs grow as the vertices do."""
    from neurolattice.operators import geometry as G
    from neurolattice.plans import registry

    seen, near = [], G.near_sensors
    monkeypatch.setattr(G, "near_sensors", lambda pairs, *rest: seen.append(pairs) or near(pairs, *rest))
    registry.QUERIES["stc_near_sensors"](spark, sf_dir)
    assert seen[0].select("right").distinct().count() <= 8


def test_make_metadata_as_by_all_pairs(spark):
    """events in one second, windows before, around and behind a row, also over the border of buckets."""
    import random

    from neurolattice.operators import events as E

    draw = random.Random(1)
    made = sorted((draw.randrange(0, 400), draw.randrange(1, 6)) for _ in range(500))
    rows = [(s, 0, i, n) for n, (s, i) in enumerate(made)]
    df = spark.createDataFrame(rows, "samp long, prev_id long, id long, row long")
    for low, high in ((-3, 18), (0, 0), (-40, -5), (2, 9)):
        near = {(n, s, i): {k: [(t - s) / 10.0 for t, j in made if j == k and s + low <= t <= s + high] for k in (1, 2)} for n, (s, i) in enumerate(made) if i in (4, 5)}
        want = {(*key, min(v[1], default=None), min(v[2], default=None)) for key, v in near.items()}
        got = E.make_metadata(df, [4, 5], {"stimulus": 1, "response": 2}, low, high, 10.0).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_labels_to_stc_adds_shared_labels(spark):
    """F8: a vertex in two labels, one in a label twice, one in a label without a course."""
    from neurolattice.operators import assemble as S

    members = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (1, 2), (3, 3)], "label long, vertex long")
    values = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 10.0)], "label long, t long, value double")
    got = {tuple(r) for r in S.labels_to_stc(members, values).select("vertex", "t", "value").collect()}
    assert got == {(1, 0, 11.0), (1, 1, 2.0), (2, 0, 2.0), (2, 1, 4.0)}
    plan = S.labels_to_stc(members, values)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [vertex" in line and "t#" in line.split("]")[0]]


def test_parcellation_in_few_rounds(spark, monkeypatch):
    """a chain of 400 edges in blocks of 64 numbers takes a round a block, not a round an edge."""
    from pyspark.sql import functions as F

    from neurolattice.operators import mesh as M

    edges = spark.range(400).selectExpr("id AS a", "id + 1 AS b", "1.0D AS weight")
    edges = edges.union(edges.select("b", "a", "weight"))
    nodes = spark.range(402).withColumnRenamed("id", "node")
    cuts, cut = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: cuts.append(1) or cut(df))
    seeds = spark.createDataFrame([(0, 0), (300, 300), (401, 401)], "node long, seed long")
    got = {r.node: (r.dist, r.seed) for r in M.nearest_seeds(edges, seeds, 64).collect()}
    assert got == {n: min((abs(n - s), s) for s in (0, 300)) for n in range(401)} | {401: (0.0, 401)} and len(cuts) < 30
    monkeypatch.setattr(M, "shortest", lambda *_: 1 / 0)
    assert M.random_parcellation(edges, nodes, 3, F.col("node")).filter("label IS NULL").select("node").collect() == [(401,)]


def test_overlap_add_takes_many_windows_at_a_time(spark):
    """windows of a recording are processed in pieces: one call of Spark's for thousands of samples."""
    import numpy as np
    import pandas as pd

    from neurolattice.operators import blocks as B

    n = 20_003
    value = np.sin(np.arange(2 * n)).reshape(2, n)
    df = spark.createDataFrame(pd.DataFrame({"rec": 0, "ch": np.repeat([0, 1], n), "samp": np.tile(np.arange(n) + 5, 2), "value": value.ravel()}))
    out = B.overlap_add(df, lambda x, ch, start: x, 16, 8)
    assert "window" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    got = out.toPandas().sort_values(["ch", "samp"])
    assert list(got["samp"]) == list(df.toPandas()["samp"]) and np.allclose(got["value"], value.ravel())


def test_merged_is_dealt_to_many_tasks(spark, sf_dir):
    """adaptive execution does not put all recordings into one task's sort."""
    from neurolattice.operators import annotations as A
    from neurolattice.plans import views as V

    assert A.merged(V.annots(spark, sf_dir)).rdd.getNumPartitions() >= 16


def test_pairs_within_are_dealt_to_tasks(spark, sf_dir):
    """of a single small file no task makes the most of the pairs."""
    from pyspark.sql import functions as F

    from neurolattice.plans import registry

    out = registry.QUERIES["spatial_dist_adjacency"](spark, sf_dir)
    rows = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) >= 4 and max(rows) < sum(rows) / 2


def test_pairs_within_as_by_brute_force(spark, monkeypatch):
    """even and clustered points, copies of places and ids, a missing coordinate; cells whole and dealt to chunks."""
    import numpy as np

    from neurolattice.operators import geometry as G

    rng = np.random.default_rng(0)
    p = np.concatenate([np.round(rng.random((150, 3)) * 8 - 4, 1), np.round(rng.random((60, 3)) / 5, 2), np.repeat([[1.0, 1.0, 1.0]], 9, 0)])
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + [(3, 0.0, 0.0, 0.0), (3, 0.1, 0.0, 0.0), (900, 1.0, None, 1.0)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double")

    def far(a, b):
        x, y, z = (u - v for u, v in zip(a[1:], b[1:]))
        return math.sqrt(x * x + y * y + z * z)

    whole = [r for r in rows if None not in r]
    every = sorted((a[0], b[0], far(a, b)) for a in whole for b in whole if far(a, b) <= 2.05)
    for chunk in (256, 16):
        monkeypatch.setattr(G, "CHUNK", chunk)
        assert sorted(tuple(r) for r in G.within(points, points, 2.05).collect()) == every
        assert sorted(tuple(r) for r in G.pairs_within(points, 2.05).collect()) == [r for r in every if r[0] != r[1]]
    crowd = points.filter("id BETWEEN 150 AND 208").crossJoin(spark.range(12).withColumnRenamed("id", "k")).selectExpr("id * 100 + k AS id", "x", "y", "z")
    assert G.pairs_within(crowd, 2.05).count() == 59 * 12 * (59 * 12 - 1)


def test_optical_density_of_rows_without_keys(spark, tmp_path):
    """samples without a channel are a channel, events without a time or an id come last, as in the SQL."""
    import datetime as dt

    import duckdb

    from neurolattice.operators import channels as C
    from neurolattice.plans import registry

    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    rows = [(1, at[0], None, 2.0), (2, at[1], None, 4.0), (3, None, 1, 1.0), (None, at[2], 1, 3.0), (5, at[2], 1, 0.0), (6, at[0], 1, 4.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").selectExpr("*", "'view' AS event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE["optical_density"]).fetchall()
    got = registry.QUERIES["optical_density"](spark, str(tmp_path)).select("ch", "samp", "value").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == set(want)
    mended = C.optical_density(events.selectExpr("user_id AS ch", "event_id AS samp", "value"))
    assert mended.columns == ["ch", "samp", "value"] and mended.count() == len(rows)


def test_pairs_within_shuffles_points_and_writes_runs(spark, tmp_path):
    """in full cells what is shuffled grows as the points, and rows of a left point follow each other in the files."""
    import os

    import numpy as np
    import pandas as pd

    from neurolattice.operators import geometry as G

    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    rng, before, n = np.random.default_rng(0), shuffled(), 16_000
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), **{c: np.round(rng.random(n) * 4, 1) for c in "xyz"}}))
    G.pairs_within(points, 1.0).write.parquet(f"{tmp_path}/pairs")
    assert shuffled() - before < 700 * n
    size = sum(os.path.getsize(f"{tmp_path}/pairs/{f}") for f in os.listdir(f"{tmp_path}/pairs"))
    assert size < 3 * spark.read.parquet(f"{tmp_path}/pairs").count()


def test_pairs_within_full_cells_as_by_brute_force(spark, monkeypatch):
    """each two blocks by themselves, with cells of one block and of several."""
    import numpy as np

    from neurolattice.operators import geometry as G

    p = np.round(np.random.default_rng(1).random((800, 3)) * 2, 1)
    far = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 1.0)) if a != b}
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    for chunk in (1 << 14, 32):
        monkeypatch.setattr(G, "CHUNK", chunk)
        got = G.pairs_within(points, 1.0).collect()
        assert {(r.left, r.right) for r in got} == want and len(got) == len(want)
        assert all(math.isclose(r.dist, far[r.left, r.right]) for r in got)
