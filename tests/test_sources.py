"""Readers, writers and streams."""

import json
import struct
from datetime import datetime

import numpy as np
import pytest

from nightloom.sources import readers, writers
from nightloom.streaming import live

XML = "<CMPStudyConfig><EpochLength>30</EpochLength><A/><B/><C/><SleepStages>{}</SleepStages></CMPStudyConfig>"


def test_profusion(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format("".join(f"<SleepStage>{s}</SleepStage>" for s in (0, 1, 2, 3, 4, 5, 9))))
    new = readers.profusion(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [r.code for r in new] == [0, 1, 2, 3, 3, 4, 0] and new[0].freq_sec == 30
    old = readers.profusion(spark, str(tmp_path), readers.PROFUSION_OLD).orderBy("epoch").collect()
    assert [r.code for r in old] == [0, 1, 2, 3, 3, 4, 9]


def test_json_and_text(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "t").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps({"values": ["WAKE", "N2"], "n_stages": 5, "freq": "30s", "start": None, "scorer": "x", "proba": None}, indent=2))
    assert [r.label for r in readers.hypnogram_json(spark, str(tmp_path / "j")).orderBy("epoch").collect()] == ["WAKE", "N2"]
    (tmp_path / "t/a.csv").write_text("stage\n0\n\n2\n\n\n")
    (tmp_path / "t/b.csv").write_text("")
    rows = readers.hypnogram_text(spark, str(tmp_path / "t"), header=True).orderBy("epoch").collect()
    assert [r.value for r in rows] == ["0", "", "2"]


def edf(x, label=b"EEG C3", unit=b"mV", sf=100):
    records = len(x) // sf
    pad = lambda v, n: v.ljust(n)[:n]
    head = pad(b"0", 8) + pad(b"", 80) + pad(b"", 80) + b"01.01.20" + b"00.00.00" + pad(b"512", 8) + pad(b"", 44) + pad(str(records).encode(), 8) + pad(b"1", 8) + pad(b"1", 4)
    fields = [(label, 16), (b"", 80), (unit, 8), (b"-1", 8), (b"1", 8), (b"-1000", 8), (b"1000", 8), (b"", 80), (str(sf).encode(), 8), (b"", 32)]
    return head + b"".join(pad(v, n) for v, n in fields) + struct.pack(f"<{records * sf}h", *x[: records * sf])


def test_edf_and_npz(spark, tmp_path):
    x = (np.arange(1000) % 2000 - 1000).tolist()
    (tmp_path / "e").mkdir()
    (tmp_path / "e/a.edf").write_bytes(edf(x))
    r = readers.signal_edf(spark, str(tmp_path / "e")).collect()
    assert len(r) == 1 and r[0].channel == "EEG C3" and r[0].sf == 100
    assert r[0]["values"][0] == -1000.0 and len(r[0]["values"]) == 1000
    h = readers.recordings_edf(spark, str(tmp_path / "e")).first()
    assert (h.meas_date, h.n_records, h.channels) == ("01.01.20 00.00.00", 10, ["EEG C3"])
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n/a.npz", data=np.ones((2, 7000)), sf=100.0)
    rows = readers.signal_npz(spark, str(tmp_path / "n")).collect()
    assert {q.channel for q in rows} == {"CHAN000", "CHAN001"} and sum(len(q["values"]) for q in rows) == 14000


def test_bdf(spark, tmp_path):
    """The same recording as an EDF file, its samples three bytes wide."""
    x = [0, 1, -1, 1999, -2000, 300]
    small = edf(x * 100, sf=100)
    start = int(small[184:192])
    wide = np.frombuffer(small, "<i2", offset=start).astype("<i4")
    body = b"".join(int(v).to_bytes(3, "little", signed=True) for v in wide)
    (tmp_path / "x.edf").write_bytes(small)
    (tmp_path / "x.bdf").write_bytes(b"\xffBIOSEMI" + small[8:start] + body)
    rows = readers.signal_edf(spark, str(tmp_path)).collect()
    by = {r.path[-3:]: (r.channel, r.sf, list(r["values"])) for r in rows}
    assert by["edf"] == by["bdf"] and len(by["bdf"][2]) == 600
    big = readers.parse_edf(b"\xffBIOSEMI" + small[8:start] + (8388607).to_bytes(3, "little", signed=True) + (-8388608).to_bytes(3, "little", signed=True) + body[6:])
    assert big[0][2][0] > 0 > big[0][2][1]


@pytest.mark.parametrize("layout", ["MULTIPLEXED", "VECTORIZED"])
def test_brainvision(spark, tmp_path, layout):
    x = np.arange(-600, 600).reshape(2, 600).astype("<i2")
    head = f"Brain Vision Data Exchange Header File Version 1.0\n[Common Infos]\nDataFile=$b.eeg\nDataFormat=BINARY\nDataOrientation={layout}\nNumberOfChannels=2\nSamplingInterval=10000\n[Binary Infos]\nBinaryFormat=INT_16\n[Channel Infos]\nCh1=C3,,0.5,µV\nCh2=a\\1b,,2,mV\n"
    (tmp_path / "one.vhdr").write_text(head, encoding="utf-8")
    (tmp_path / "one.eeg").write_bytes((x.T if layout == "MULTIPLEXED" else x).tobytes())
    (tmp_path / "lost.vhdr").write_text(head, encoding="utf-8")
    rows = readers.signal_brainvision(spark, str(tmp_path)).orderBy("ch_idx").collect()
    assert [(r.channel, r.sf, r.start_sample) for r in rows] == [("C3", 100.0, 0), ("a,b", 100.0, 0)]
    assert list(rows[0]["values"]) == (x[0] * 0.5).tolist() and list(rows[1]["values"]) == (x[1] * 2000.0).tolist()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, [1, 2]), ("b", None, None)], "k string, x double, v array<int>")
    writers.to_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    writers.to_annotations(df, str(tmp_path / "a"), "x", "x", "spindle")
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).columns == ["onset", "label", "duration"]
    writers.to_parquet(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.to_json(df, "k", str(tmp_path / "j"))
    assert {r.value for r in spark.read.text(str(tmp_path / "j")).collect()} == {"a", "b"}


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k string, ts timestamp, stage string, x double").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("k string, ts timestamp, stage string, x double").parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def at(s):
    return datetime.fromtimestamp(1_600_000_000 + s)


def test_streams(spark, tmp_path):
    rows = [("a", at(10 * i), "N2" if i < 6 else "REM", float(i)) for i in range(12)] + [("a", at(100_000), "W", 0.0)]
    s = stream(spark, tmp_path, rows)
    bouts = run(spark, live.bouts(s, "k", "ts", "stage"), tmp_path, "bouts")
    assert [(r.stage, r.n) for r in sorted(bouts, key=lambda r: r["first"])][:2] == [("N2", 6), ("REM", 6)]
    windows = run(spark, live.tumbling(s, ["k"], "ts", "x"), tmp_path, "windows")
    assert sum(r.n for r in windows) == 12
    assert len(run(spark, live.sliding(s, ["k"], "ts", "x", "60 seconds", "30 seconds"), tmp_path, "slide")) >= 4
    assert len(run(spark, live.once(s.unionByName(s), ["k", "ts"], "ts"), tmp_path, "once")) == 13
