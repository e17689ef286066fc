"""Wrong readings that fill most of a stage's stretch of the night."""

import numpy as np
from pyspark.sql import functions as F

from nightloom.operators import spikes


def test_mostly_wrong_cell(spark):
    rng = np.random.default_rng(5)
    values = [60 + float(np.clip(rng.normal(), -3, 3)) * 2 for _ in range(400)]
    wrong = list(range(0, 75, 3))  # 25 of the 40 readings of stage 2 in the first two hours
    for i in wrong:
        values[i] = 110.0 + 0.1 * i
    rows = [(i, "s", float(i * 60), 2 + i % 3, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id bigint, src string, t double, stage int, hr double")
    got = spikes.flag(df, ident="id", source="src", time="t", season="stage", fields={"hr": (20, 250)})
    assert sorted(r.ident for r in got.where("extreme").collect()) == wrong
    assert got.where(F.abs("residual") > 20).count() == len(wrong)
