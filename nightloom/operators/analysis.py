"""Workflows on top of the operators: artefacts in hypnograms, rank correlation, feature ranking, plot data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_artefacts(hyp: DataFrame, artefacts: DataFrame, keys: Sequence[str], window: float, freq: Column | float, share: float = 0.0, carried: bool = False) -> DataFrame:
    """``hyp`` with code -1 where more than ``share`` of an epoch's artefact windows are bad.

    hyp: one row an epoch, one epoch length ``freq`` a sequence. artefacts:
    ``(keys, epoch, artefact)`` counted in windows of ``window`` seconds.
    carried: ``artefacts`` has the column ``freq`` too, and ``last``, the
    sequence's last epoch, so ``hyp`` needn't be read again for them.

    Each window is given the numbers of the epochs it touches and counted beside
    them: where both tables are spread by ``keys`` already, nothing is shuffled
    again, and nothing is broadcast.
    """
    length = freq if isinstance(freq, Column) else F.lit(float(freq))
    a = artefacts.where(" and ".join(f"`{k}` is not null" for k in keys))
    a = a.select(*keys, F.col("epoch").cast("bigint").alias("_w"), F.col("artefact").cast("double").alias("_bad"), *([length.alias("_f"), F.col("last").alias("_l")] if carried else []))
    if not carried:
        # a row a sequence: few in a task, too many for the driver
        a = a.join(hyp.groupBy(*keys).agg(F.max(length).alias("_f"), F.max("epoch").alias("_l")).hint("shuffle_hash"), list(keys))
    a = a.where("_bad is not null and _f is not null and (_f <> 0 or _w = 0)")  # epochs without length are all in window 0
    # from the first to the last epoch that the window may touch, wider by more than rounding; which it does touch, the epochs say
    ends = [F.try_divide((F.col("_w") + k) * window, F.col("_f")) for k in (0, 1)]
    wide = lambda x, sign: x + sign * (F.abs(x) * 1e-12 + 1e-9)
    a = a.withColumns({"_a": F.floor(F.greatest(F.lit(0.0), wide(F.least(*ends), -1))), "_b": F.floor(F.least(F.col("_l").cast("double"), wide(F.greatest(*ends), 1)))})
    touched = a.where("_a <= _b").withColumn("_e", F.explode(F.sequence("_a", "_b")))
    first = F.floor(F.col("_e") * F.col("_f") / window)
    touched = touched.where((F.col("_w") >= first) & (F.col("_w") <= F.greatest(first, F.ceil((F.col("_e") + 1) * F.col("_f") / window) - 1)))
    own = [c for c in hyp.columns if c not in (*keys, "epoch")]
    kinds = {f.name: f.dataType for f in hyp.schema}
    rows = hyp.select(*keys, F.col("epoch").cast("bigint").alias("epoch"), *own, F.lit(True).alias("_own"), F.lit(None).cast("double").alias("_bad"))
    counts = touched.select(*keys, F.col("_e").alias("epoch"), *[F.lit(None).cast(kinds[c]).alias(c) for c in own], F.lit(None).cast("boolean").alias("_own"), "_bad")
    both = rows.union(counts).groupBy(*keys, "epoch").agg(*[F.first(c, ignorenulls=True).alias(c) for c in own], F.max("_own").alias("_own"), F.avg("_bad").alias("_s"))
    marked = both.where("_own").withColumns({"epoch": F.col("epoch").cast(kinds["epoch"]), "code": F.when(F.col("_s") > share, -1).otherwise(F.col("code"))})
    return marked.select(*hyp.columns)


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank within ``by``, ties sharing their mean rank; null for null."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """``(by, n, rho)``: rank correlation per group of the rows that have both values; null without spread."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": average_rank(x, by), "_y": average_rank(y, by)})
    rho = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def anova_f(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """``(feature, f)``: one-way F of each column over the labels, greatest first; null without spread within labels."""
    long = df.where(F.col(label).isNotNull()).unpivot([label], list(columns), "feature", "value").where("value is not null")
    g = long.groupBy("feature", label).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    total = g.groupBy("feature").agg(F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = g.join(total, "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mu"), F.lit(2.0))).alias("between"))
    f = F.try_divide(F.col("between") / F.nullif(F.col("k") - 1, F.lit(0)), F.try_divide(F.col("within"), F.col("total_n") - F.col("k")))
    return total.join(between, "feature").select("feature", f.alias("f")).orderBy(F.desc_nulls_last("f"))


def quantile_limits(df: DataFrame, by: Sequence[str], columns: Sequence[str], low: float, high: float) -> DataFrame:
    """``df`` kept where every column lies within its group's quantiles (percentile thresholds instead of absolute ones)."""
    q = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"_q_{c}") for c in columns])
    rows = df.join(q, list(by))
    for c in columns:
        rows = rows.where((F.col(c) >= F.col(f"_q_{c}")[0]) & (F.col(c) <= F.col(f"_q_{c}")[1]))
    return rows.drop(*[f"_q_{c}" for c in columns])


def zscored(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns as z scores within groups (population SD); null without spread."""
    w = Window.partitionBy(*by)
    return df.withColumns({c: F.try_divide(F.col(c) - F.avg(c).over(w), F.stddev_pop(c).over(w)) for c in columns})


def change_points(hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, epoch, code)`` where the stage differs from the epoch before: the corners of a drawn hypnogram."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    return hyp.withColumn("_p", F.lag("code").over(w)).where(F.col("_p").isNull() | (F.col("_p") != F.col("code"))).drop("_p")


def density(proba: DataFrame, keys: Sequence[str], column: str = "proba") -> DataFrame:
    """``(keys, epoch, label, p, cumulative)``: probabilities in long form, stacked in label order."""
    long = proba.select(*keys, "epoch", F.explode(column).alias("label", "p"))
    w = Window.partitionBy(*keys, "epoch").orderBy("label")
    return long.withColumn("cumulative", F.sum("p").over(w))


def difference_plot(diff: DataFrame, limits: DataFrame) -> DataFrame:
    """``(sleep_stat, x, y, bias, lower, upper)``: the points and lines of a difference plot."""
    return diff.select("sleep_stat", F.col("ref").alias("x"), F.col("difference").alias("y")).join(limits.select("sleep_stat", "bias", "lower", "upper"), "sleep_stat")


def remapped(hyp: DataFrame, mapping: Mapping[int, int]) -> DataFrame:
    """``hyp`` under the user's own integers; -1 and -2 stay unless named, a code without a target fails the query."""
    full = {-1: -1, -2: -2, **mapping}
    table = F.create_map(*[x for k, v in full.items() for x in (F.lit(k), F.lit(v))])
    found = F.try_element_at(table, F.col("code").cast("int"))
    return hyp.withColumn("code", F.when(F.col("code").isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no integer for "), F.col("code").cast("string"))).cast("int"))))


def proba_violations(proba: DataFrame, keys: Sequence[str], column: str = "proba", tolerance: float = 1e-5) -> DataFrame:
    """``(keys, epoch, total)`` of the epochs whose probabilities (a map) don't sum to 1 or lie outside [0, 1]."""
    values = F.map_values(column)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    wrong = (F.abs(total - 1) > tolerance) | F.exists(values, lambda x: (x < 0) | (x > 1))
    return proba.where(wrong).select(*keys, "epoch", total.alias("total"))
