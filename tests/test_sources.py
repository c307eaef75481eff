"""Files forth and back, and text formats."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurolattice.sources import recordings, sinks, texts


@pytest.fixture
def samples(spark):
    x = np.round(np.random.default_rng(0).standard_normal((3, 450)) * 50, 3)
    return x, spark.createDataFrame([(c, s, float(x[c, s])) for c in range(3) for s in range(450)], "ch int, samp long, value double")


def back(df, n):
    out = np.full((3, n), np.nan)
    for r in df.collect():
        out[r["ch"], r["samp"]] = r["value"]
    return out


def test_edf(spark, samples, tmp_path):
    x, df = samples
    path = str(tmp_path / "a.edf")
    sinks.export_edf(df, path, 100, ["Fz", "Cz", "Pz"])
    got = recordings.read_raw(spark, path)
    assert np.abs(back(got, 500)[:, :450] - x).max() < 0.01
    assert {r["ch_name"] for r in got.filter("ch = 1").collect()} == {"Cz"}
    assert got.filter("ch = 1 AND samp >= 10 AND samp <= 19").count() == 10


def test_sinks_in_pieces(spark, tmp_path):
    """Many pieces and batches; small values; what is missing or repeated is an error, nothing is left behind."""
    x = np.random.default_rng(1).standard_normal((3, 2345)) * 2e-6
    df = spark.createDataFrame([(c, s, float(x[c, s])) for c in range(3) for s in range(2345)], "ch int, samp long, value double").withColumn("samp", F.col("samp") + 7)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sinks, "COPY", 1000)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        sinks.export_edf(df, str(tmp_path / "a.edf"), 100, ["a", "b", "c"], "V")
        sinks.export_brainvision(df, str(tmp_path / "b"), 100.0, ["a", "b", "c"])
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    edf, bv = ({(r["ch"], r["samp"]): r["value"] for r in recordings.read_raw(spark, str(tmp_path / f)).collect()} for f in ("a.edf", "b.vhdr"))
    assert len(edf) == 3 * 2400 and len(bv) == x.size
    assert max(abs(edf[c, s] - x[c, s]) for c in range(3) for s in range(2345)) < np.abs(x).max() * 1.2 / 32767 and edf[2, 2399] == pytest.approx(0, abs=1e-9)
    assert max(abs(bv[c, s] - x[c, s]) for c in range(3) for s in range(2345)) < 1e-12
    for bad in (df.filter("samp <> 50 OR ch <> 1"), df.filter("samp <> 50 OR ch <> 1").union(df.filter("samp = 51 AND ch = 1")), df.filter("ch < 2")):
        with pytest.raises(Exception):  # noqa: B017
            sinks.export_edf(bad, str(tmp_path / "c.edf"), 100, ["a", "b", "c"])
    sinks.export_brainvision(df.limit(0), str(tmp_path / "d"), 100.0, ["a"])
    sinks.export_edf(df.limit(0), str(tmp_path / "e.edf"), 100, ["a"])
    assert recordings.read_raw(spark, str(tmp_path / "d.vhdr")).count() == recordings.read_raw(spark, str(tmp_path / "e.edf")).count() == 0
    assert {p.name for p in tmp_path.iterdir()} == {"a.edf", "b.eeg", "b.vhdr", "b.vmrk", "d.eeg", "d.vhdr", "d.vmrk", "e.edf"}
    assert [sinks.bound(v) for v in (1e-9, 176.2339, 1234567.0)] == ["1.1e-09", "176.236", "1.4e+06"]


def test_bdf(spark, tmp_path):
    path = tmp_path / "b.bdf"
    pad = lambda s, k: str(s).ljust(k).encode()
    head = b"\xffBIOSEMI" + pad("", 80) + pad("", 80) + pad("", 16) + pad(512, 8) + pad("", 44) + pad(2, 8) + pad(1, 8) + pad(1, 4)
    fields = pad("A1", 16) + pad("", 80) + pad("uV", 8) + pad(-8388608, 8) + pad(8388607, 8) + pad(-8388608, 8) + pad(8388607, 8) + pad("", 80) + pad(3, 8) + pad("", 32)
    values = [1, -1, 8388607, -8388608, 0, 65536]
    path.write_bytes(head + fields + b"".join(struct.pack("<i", v)[:3] for v in values))
    assert [r["value"] for r in recordings.read_raw(spark, str(path)).orderBy("samp").collect()] == values


def test_brainvision(spark, samples, tmp_path):
    x, df = samples
    sinks.export_brainvision(df, str(tmp_path / "c"), 250.0, ["Fz", "C,z", "Pz"])
    got = recordings.read_raw(spark, str(tmp_path / "c.vhdr"))
    assert np.abs(back(got, 450) - x).max() < 1e-4 and {r["ch_name"] for r in got.filter("ch = 1").collect()} == {"C,z"}
    (tmp_path / "c.vmrk").write_text("[Marker Infos]\nMk1=New Segment,,1,1,0\nMk2=Stimulus,S  1,21,1,0\n")
    assert recordings.brainvision_markers(str(tmp_path / "c.vmrk")) == [("New Segment", "", 0, 1, 0), ("Stimulus", "S  1", 20, 1, 0)]
    with pytest.raises(ValueError):
        recordings.read_raw(spark, "x.unknown")


def test_raw_parquet(spark, samples, tmp_path):
    sinks.save_raw(samples[1].withColumn("rec", F.lit(1)), str(tmp_path / "raw.parquet"))
    assert recordings.read_raw(spark, str(tmp_path / "raw.parquet")).count() == 1350


def test_texts(spark, tmp_path):
    (tmp_path / "a.eve").write_text("# list\n10 0 1\n20 1 2\n")
    (tmp_path / "b.eve").write_text("10 0.1 0 1\n20 0.2 1 3\n")
    assert [tuple(r) for r in texts.read_events(spark, str(tmp_path / "a.eve")).collect()] == [(10, 0, 1), (20, 1, 2)]
    assert [tuple(r) for r in texts.read_events(spark, str(tmp_path / "b.eve"), include=[3]).collect()] == [(20, 1, 3)]
    texts.write_events(texts.read_events(spark, str(tmp_path / "a.eve")), str(tmp_path / "out"))
    assert texts.read_events(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "ann.csv").write_text("onset,duration,description\n1.5,0.5,BAD_x\n2,0,go\n")
    assert [tuple(r) for r in texts.read_annotations(spark, str(tmp_path / "ann.csv")).collect()] == [(1.5, 0.5, "BAD_x"), (2.0, 0.0, "go")]
    (tmp_path / "l.label").write_text("#!ascii label\n2\n5 1.0 2.0 3.0 0.5\n9 4.0 5.0 6.0 0.0\n")
    assert [r["vertex"] for r in texts.read_label(spark, str(tmp_path / "l.label")).collect()] == [5, 9]
    (tmp_path / "e.asc").write_text("MSG 1 x\n100 1.0 2.0 900\n102 . . 0\nEFIX L 100 102 3 1.0 2.0 900\nEBLINK L 104 120 17\n")
    s, a = texts.read_eyelink(spark, str(tmp_path / "e.asc"))
    assert s.count() == 2 and {r["description"] for r in a.collect()} == {"fixation", "BAD_blink"}
    (tmp_path / "x.mul").write_text("TimePoints= 2 Channels= 2 BeginSweep[ms]= -100 SamplingInterval[ms]= 5\nFz Cz\n1.0 2.0\n3.0 4.0\n")
    got = {(r["ch_name"], r["t"]): r["value"] for r in texts.read_besa(spark, str(tmp_path / "x.mul")).collect()}
    assert got == {("Fz", 0): pytest.approx(1e-6), ("Cz", 0): pytest.approx(2e-6), ("Fz", 1): pytest.approx(3e-6), ("Cz", 1): pytest.approx(4e-6)}
