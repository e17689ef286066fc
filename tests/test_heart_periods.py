"""Heart-rate queries over users with beats in many periods, against brute force."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from nightloom.plans import sig


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """A folder with the events of a user of 600 beats, one of 90 and one of 1, and each user's event ids in order."""
    folder, day = tmp_path_factory.mktemp("events"), datetime(2024, 1, 1)
    rows = [((i * 7) % 600, 1, day + timedelta(seconds=i // 2)) for i in range(600)]
    rows += [(1000 + i, 2, day + timedelta(seconds=i)) for i in range(90)] + [(2000, 3, day)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(f"{folder}/events.parquet")
    order = defaultdict(list)
    for ident, user, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        order[user].append(ident)
    return str(folder), order


def beats(order):
    return {user: [i * 0.8 + (ident % 7) * 0.01 for i, ident in enumerate(idents)] for user, idents in order.items()}


def test_beats_of_all_periods(spark, events):
    folder, order = events
    want = Counter((user, int(t // 20)) for user, at in beats(order).items() for t in at)
    got = {(r.user_id, r.period): r.n_beats for r in sig.hrv_beats(spark, folder).collect()}
    assert got == want and sum(got.values()) == 691 and max(p for u, p in got if u == 1) == 23


def measured(at, limit=10):
    """Mean and SD of the heart rate and RMSSD of a period's beats, intervals of 400 to 2000 ms kept and others interpolated."""
    rr = np.diff(sorted(at)) * 1000
    known = np.flatnonzero((rr >= 400) & (rr <= 2000))
    near = len(known) > 0 and all(np.abs(known - i).min() <= limit for i in range(len(rr)))
    if not near or 60 * len(at) / 30 < 30:
        return None, None, None
    rr = np.interp(np.arange(len(rr)), known, rr[known])
    hr = 60000 / rr
    return hr.mean(), hr.std(ddof=1), np.sqrt((np.diff(rr) ** 2).mean())


def test_intervals_of_all_periods(spark, events):
    folder, order = events
    periods = defaultdict(list)
    for user, at in beats(order).items():
        for t in at:
            t += 1.7 if int(t) % 5 == 0 else 0.0
            periods[user, int(t // 30)].append(t)
    got = {(r.user_id, r.period): r for r in sig.hrv_rr_filter(spark, folder).collect()}
    assert {k: r.n_beats for k, r in got.items()} == {k: len(at) for k, at in periods.items()}
    assert max(p for u, p in got if u == 1) >= 15
    known = 0
    for key, at in periods.items():
        for x, want in zip((got[key].hr_mean, got[key].hr_std, got[key].hrv_rmssd), measured(at)):
            assert (x is None) == (want is None), key
            if want is not None:
                known += 1
                assert x == pytest.approx(want, abs=2e-6), key
    assert known >= 45
