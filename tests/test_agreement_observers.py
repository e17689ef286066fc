"""Sessions of more than two scorers."""

from nightloom.operators import agreement as A


def test_every_observer(spark):
    rows = [("s", w, e, (e + k) % 5) for k, w in enumerate("abcd") for e in range(6 - k)] + [("t", "a", 0, 1)]
    got = A.paired_first(spark.createDataFrame(rows, "session string, scorer string, epoch int, code int"), "session", "scorer").collect()
    assert {tuple(r) for r in got} == {("s", w, e, e % 5, (e + k) % 5) for k, w in enumerate("abcd") if k for e in range(6 - k)} and len(got) == 12
