"""FIF files: what the sink writes is what the sources read; files laid out by hand from the format's definition."""

import struct

import numpy as np
import pytest

from neurolattice.sources import fiff, recordings


def rows(spark, x, low=0, keep=None):
    data = [(c, low + s, float(x[c, s])) for c in range(x.shape[0]) for s in range(x.shape[1]) if keep is None or keep(c, s)]
    return spark.createDataFrame(data, "ch int, samp long, value double")


def got(df):
    out = [(r["ch"], r["samp"], r["value"]) for r in df.collect() if r["value"] == r["value"]]
    assert len({o[:2] for o in out}) == len(out)
    return {o[:2]: o[2] for o in out}


@pytest.mark.parametrize("double", [True, False])
def test_split_recording(spark, tmp_path, double):
    x = np.random.default_rng(1).standard_normal((3, 1037))
    path = str(tmp_path / "a.fif")
    n = fiff.export_fif(rows(spark, x, 50).repartition(7), path, 10.0, ["Fz", "a channel of a long name", "Pz"], split_bytes=(1 << 16) + 6000, double=double)
    assert n > 1 and sorted(p.name for p in tmp_path.glob("*")) == sorted(fiff.part_name("a.fif", k) for k in range(n))
    for source in (path, str(tmp_path)):
        df = recordings.read_raw(spark, path) if source == path else spark.read.format("fif").load(source)
        back = got(df)
        assert len(back) == x.size
        assert all(abs(back[c, 50 + s] - x[c, s]) <= (0 if double else 1e-6) for c in range(3) for s in range(1037))
        assert {(r["rec"], r["ch_name"]) for r in df.select("rec", "ch_name").distinct().collect()} == {("a.fif", v) for v in ("Fz", "a channel of a long name", "Pz")}
    assert sorted(got(recordings.read_raw(spark, path).filter("ch = 1 AND samp >= 400 AND samp <= 405"))) == [(1, s) for s in range(400, 406)]
    (tmp_path / "a-1.fif").unlink()
    with pytest.raises(Exception, match="a-1.fif"):
        recordings.read_raw(spark, path).count()


def test_ranges_do_not_change_rows(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(2).standard_normal((2, 500))
    path = str(tmp_path / "b.fif")
    fiff.export_fif(rows(spark, x), path, 7.0, ["a", "b"], double=True)
    monkeypatch.setattr(fiff, "RANGE", 300)
    monkeypatch.setattr(fiff, "ROWS", 5)
    reader = fiff.RawReader(path)
    assert len(reader.partitions()) > 20
    found = [(c, s, v) for p in reader.partitions() for b in reader.read(p) for c, s, v in zip(b["ch"].to_pylist(), b["samp"].to_pylist(), b["value"].to_pylist(), strict=True)]
    assert sorted(found) == sorted((c, s, x[c, s]) for c in range(2) for s in range(500))


def test_gaps(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((2, 400))
    keep = lambda c, s: not (20 <= s < 95 or 330 <= s < 396 or (c == 1 and s % 7 == 0))
    for i, split in enumerate((1 << 29, (1 << 16) + 900)):  # the second has files without a sample
        path = str(tmp_path / f"{i}.fif")
        fiff.export_fif(rows(spark, x, 3, keep), path, 10.0, ["a", "b"], split_bytes=split, double=True)
        assert got(recordings.read_raw(spark, path)) == {(c, 3 + s): x[c, s] for c in range(2) for s in range(400) if keep(c, s)}


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "c.fif")
    assert fiff.export_fif(rows(spark, np.zeros((1, 0))), path, 10.0, ["a"]) == 1
    assert recordings.read_raw(spark, path).count() == 0
    assert fiff.export_fif(rows(spark, np.ones((1, 3))), path, 10.0, ["a"]) == 1  # again: replaced
    assert recordings.read_raw(spark, path).count() == 3
    one = rows(spark, np.ones((1, 3)))
    for bad in (one.union(one), one.selectExpr("CAST(NULL AS int) AS ch", "samp", "value"), one.selectExpr("ch + 1 AS ch", "samp", "value"), one.selectExpr("ch", "samp + 3000000000 AS samp", "value")):
        with pytest.raises(Exception):  # noqa: B017
            fiff.export_fif(bad, str(tmp_path / "d.fif"), 10.0, ["a"])
    assert not list(tmp_path.glob("*.part")) and not list(tmp_path.glob("d*"))
    with pytest.raises(ValueError):
        fiff.export_fif(one, str(tmp_path / "e.raw"), 10.0, ["a"])


def head(*gains):
    info = [fiff.int_tag(fiff.NCHAN, len(gains)), fiff.tag(fiff.SFREQ, fiff.FLOAT, struct.pack(">f", 100.0))]
    info += [fiff.tag(fiff.CH_INFO, fiff.CH_STRUCT, struct.pack(">3i2fi12f2i16s", i, i, 1, g, 2.0, 0, *[0.0] * 12, 112, 0, b"M%d" % i)) for i, g in enumerate(gains)]
    return fiff.tag(100, 31, bytes(20)), fiff.block(fiff.B_MEAS_INFO, *info)


def test_shorts_skips_and_directory(spark, tmp_path):
    ident, info = head(0.5, 3.0)
    short = lambda v: fiff.tag(fiff.DATA_BUFFER, 16, np.array(v, ">i2").tobytes())
    start = struct.pack(">i", fiff.B_RAW)
    raw = [fiff.tag(fiff.BLOCK_START, 3, start), fiff.int_tag(fiff.FIRST_SAMPLE, 10), fiff.int_tag(fiff.DATA_SKIP, 2), short([1, 2, 3, 4]), fiff.int_tag(fiff.DATA_SKIP, 1), short([5, 6, 7, 8]), fiff.int_tag(fiff.DATA_SKIP_SAMP, 3), short([-9, 9]), fiff.tag(fiff.BLOCK_END, 3, start)]
    expected = {}
    for samp, a, b in ((14, 1, 2), (15, 3, 4), (18, 5, 6), (19, 7, 8), (23, -9, 9)):
        expected |= {(0, samp): a * 1.0, (1, samp): b * 6.0}
    (tmp_path / "s.fif").write_bytes(ident + fiff.int_tag(fiff.DIR_POINTER, -1) + info + b"".join(raw))
    assert got(recordings.read_raw(spark, str(tmp_path / "s.fif"))) == expected
    # the same, found by a directory behind it; what lies between is never walked over
    body = ident + fiff.int_tag(fiff.DIR_POINTER, 0) + info + b"\x7f" * 40
    places, place = [], len(body)
    for t in raw:
        places.append((*struct.unpack(">3i", t[:12]), place))
        place += len(t)
    at, inner = len(ident) + 20, []
    while at < len(ident) + 20 + len(info):
        kind, form, size, _ = struct.unpack(">4i", body[at : at + 16])
        inner.append((kind, form, size, at))
        at += 16 + size
    entries = np.array([*inner, *places, (-1, -1, -1, -1)], ">i4")
    body = ident + fiff.int_tag(fiff.DIR_POINTER, place) + body[len(ident) + 20 :]
    (tmp_path / "t.fif").write_bytes(body + b"".join(raw) + fiff.tag(fiff.DIR, 32, entries.tobytes(), -1))
    assert got(recordings.read_raw(spark, str(tmp_path / "t.fif"))) == expected


def array(kind, values, form=">f8"):
    dims = struct.pack(f">{values.ndim}i", *values.shape[::-1]) + struct.pack(">i", values.ndim)
    return fiff.tag(kind, {">f8": 5, ">f4": 4}[form] | 0x40000000, values.astype(form).tobytes() + dims)


def epochs_file(events, x, *more):
    ident, info = head(1.0, 0.5)
    list_tag = fiff.tag(fiff.EVENT_LIST, 3, np.array(events, ">i4").tobytes())
    return ident + fiff.block(fiff.B_MEAS, info, fiff.block(fiff.B_EPOCHS, fiff.block(fiff.B_EVENTS, list_tag), fiff.int_tag(fiff.FIRST_SAMPLE, -2), fiff.int_tag(fiff.LAST_SAMPLE, x.shape[2] - 3), array(fiff.EPOCH, x), *more))


def test_epochs(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(4).standard_normal((5, 2, 6))
    events = [[100 * i, 0, i % 2 + 1] for i in range(5)]
    ref = lambda role, name: fiff.block(fiff.B_REF, fiff.int_tag(fiff.REF_ROLE, role), fiff.tag(fiff.REF_FILE_NAME, 10, name))
    (tmp_path / "x-epo.fif").write_bytes(epochs_file(events[:3], x[:3], ref(2, b"x-epo-1.fif")))
    (tmp_path / "x-epo-1.fif").write_bytes(epochs_file(events[3:], x[3:], ref(1, b"x-epo.fif")))
    recordings.register(spark)
    expected = {(e, 100 * e, e % 2 + 1, c, t - 2): x[e, c, t] * (2.0, 1.0)[c] for e in range(5) for c in range(2) for t in range(6)}
    for path in (tmp_path / "x-epo.fif", tmp_path):
        df = spark.read.format("fif_epochs").load(str(path))
        assert {(r["epoch"], r["samp"], r["code"], r["ch"], r["t"]): r["value"] for r in df.collect()} == pytest.approx(expected)
        assert df.filter("ch = 1 AND samp >= 300").count() == 2 * 6
        assert {r["rec"] for r in df.collect()} == {"x-epo.fif"}
    monkeypatch.setattr(fiff, "RANGE", 90)
    reader = fiff.EpochsReader(str(tmp_path / "x-epo.fif"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == x.size


def test_evoked(spark, tmp_path):
    ident, info = head(0.5, 0.5)
    x = np.random.default_rng(5).standard_normal((2, 4))
    vectors = [fiff.tag(fiff.EPOCH, 4, row.astype(">f4").tobytes()) for row in x]
    aspect = lambda kind, nave, *data: fiff.block(fiff.B_ASPECT, fiff.int_tag(fiff.ASPECT_KIND, kind), fiff.int_tag(fiff.NAVE, nave), *data)
    one = fiff.block(fiff.B_EVOKED, fiff.tag(fiff.COMMENT, 10, b"left"), fiff.int_tag(fiff.FIRST_SAMPLE, -1), fiff.int_tag(fiff.LAST_SAMPLE, 2), aspect(100, 40, array(fiff.EPOCH, x)), aspect(101, 40, array(fiff.EPOCH, x / 10)))
    two = fiff.block(fiff.B_EVOKED, fiff.tag(fiff.COMMENT, 10, b"right"), fiff.int_tag(fiff.FIRST_SAMPLE, 0), fiff.int_tag(fiff.LAST_SAMPLE, 3), aspect(100, 7, *vectors))
    (tmp_path / "e-ave.fif").write_bytes(ident + fiff.block(fiff.B_MEAS, info, one, two))
    recordings.register(spark)
    found = {(r["evoked"], r["comment"], r["kind"], r["nave"], r["ch"], r["t"]): r["value"] for r in spark.read.format("fif_evoked").load(str(tmp_path)).collect()}
    expected = {}
    for c in range(2):
        for t in range(4):
            expected |= {(0, "left", 100, 40, c, t - 1): x[c, t], (1, "left", 101, 40, c, t - 1): x[c, t] / 10, (2, "right", 100, 7, c, t): x[c, t]}
    assert found == pytest.approx(expected, abs=1e-6)


def test_complex_refused(spark, tmp_path):
    ident, info = head(1.0)
    (tmp_path / "z.fif").write_bytes(ident + fiff.block(fiff.B_MEAS, info, fiff.block(fiff.B_RAW, fiff.tag(fiff.DATA_BUFFER, 20, bytes(16)))))
    with pytest.raises(Exception, match="not real"):
        recordings.read_raw(spark, str(tmp_path / "z.fif")).count()
