"""Heart-rate variability of a hypnogram's periods."""

import pytest

from nightloom.operators import heart


def test_by_stage(spark):
    codes = [0] * 4 + [2] * 6 + [3] * 3 + [2] * 4 + [4] * 5  # 30 s epochs; the run of 3 is too short
    hyp = spark.createDataFrame([("r", e, c) for e, c in enumerate(codes)], "rec string, epoch int, code int")
    beats = spark.createDataFrame([("r", 0.9 * i + (0.05 if i % 2 else 0.0)) for i in range(int(510 / 0.9))], "rec string, beat double")
    got = {(r.stage, r.epoch): r for r in heart.by_stage(hyp, beats, ["rec"], 30.0).collect()}
    assert {k: (r.start, r.duration) for k, r in got.items()} == {(2, 0): (120.0, 180.0), (2, 1): (390.0, 120.0), (4, 0): (510.0, 150.0)}
    at = [r.beat for r in beats.collect()]
    for k in ((2, 0), (2, 1)):
        r = got[k]
        assert r.n_beats == sum(r.start <= t < r.start + r.duration for t in at)
        assert r.hrv_rmssd == pytest.approx(100.0) and 66 < r.hr_mean < 68
    assert got[4, 0].n_beats == 0 and got[4, 0].hr_mean is None
    cut = heart.by_stage(hyp, beats, ["rec"], 30.0, equal_length=True).where("stage = 2").orderBy("epoch").collect()
    assert [(r.epoch, r.start, r.duration) for r in cut] == [(0, 120.0, 120.0), (1, 390.0, 120.0)]
