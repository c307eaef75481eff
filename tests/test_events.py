"""Literal cases of event operators, and the entry."""

import pytest

from neurolattice.operators import events as E

SCHEMA = "samp long, prev_id long, id long, row long"


def rows(df):
    return sorted((r["samp"], r["prev_id"], r["id"]) for r in df.collect())


def test_merge(spark):
    df = spark.createDataFrame([(1, 0, 1, 0), (3, 0, 2, 1), (10, 0, 3, 2), (20, 0, 4, 3)], SCHEMA)
    for keep in (True, False):
        out = df
        for ids, new in (([1, 2], 12), ([3, 4], 34), ([1, 2, 3, 4], 1234)):
            out = E.merge_events(out, ids, new, replace=not keep)
        if not keep:
            assert rows(out) == [(1, 0, 12), (3, 0, 12), (10, 0, 34), (20, 0, 34)]
        else:
            assert rows(out) == sorted((s, 0, i) for s, a, b in ((1, 1, 12), (3, 2, 12), (10, 3, 34), (20, 4, 34)) for i in (a, b, 1234))


def test_define_target(spark):
    listed = [(0, 1), (375, 2), (500, 1), (875, 3), (1000, 1), (1375, 3), (1100, 1), (1475, 2), (1500, 1), (1875, 2)]
    df = spark.createDataFrame([(s, 0, i, k) for k, (s, i) in enumerate(listed)], SCHEMA)
    got = E.define_target_events(df, 1, 2, 250.0, 1.4, 1.6, 5).collect()
    assert [r["lag"] for r in got] == [1500.0] * 3 and {r["id"] for r in got} == {5}
    filled = E.define_target_events(df, 1, 2, 250.0, 1.4, 1.6, 5, 99).orderBy("row").collect()
    assert [r["lag"] for r in filled] == [1500.0, None, None, 1500.0, 1500.0] and [r["id"] for r in filled] == [5, 99, 99, 5, 5]


@pytest.mark.parametrize("consecutive,want", [("increasing", [(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]), (True, [(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)]), (False, [(1, 0, 1)])])
def test_find(spark, consecutive, want):
    stim = spark.createDataFrame([(0, s, c) for s, c in enumerate([0, 1, 2, 3, 4, 0, 0, 0])], "ch long, samp long, code long")
    assert rows(E.find_events(stim, consecutive=consecutive)) == want
    assert rows(E.find_events(stim.limit(0))) == []


def test_find_ends(spark):
    stim = spark.createDataFrame([(0, s, c) for s, c in enumerate([4, 4, 0, 0, 2, 2, 0])], "ch long, samp long, code long")
    assert rows(E.find_events(stim)) == [(4, 0, 2)]
    assert rows(E.find_events(stim, initial_event=True)) == [(0, 0, 4), (4, 0, 2)]
    assert rows(E.find_events(stim, "offset", initial_event=True)) == [(1, 0, 4), (5, 0, 2)]


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["condition", "ch", "t", "value", "se", "nave"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
