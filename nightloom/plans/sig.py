"""Named queries on signals: embeddings as 64-sample epochs, events per user as a sampled series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import heart
from ..operators import windows as W
from ..tables import table

QUERIES, SQL = {}, {}
_N = 64
BANDS = [(0.5, 4, "Delta"), (4, 8, "Theta"), (8, 12, "Alpha"), (12, 16, "Sigma"), (16, 30, "Beta")]
GRID = [0.5 * i for i in range(_N)]

_VIEWS = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings),
x AS (SELECT vec_id, label, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS i FROM v),
u AS (SELECT user_id, value, event_id % 17 AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample, count(*) OVER (PARTITION BY user_id) AS n FROM events)
"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _VIEWS + sql
        return f

    return add


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))


def series(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select("user_id", "value", (F.col("event_id") % 17).alias("y"), (F.row_number().over(w) - 1).cast("bigint").alias("sample"))
    return e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id")))


def _r(df, keep, cols, digits=6):
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in cols])


@query(
    """, m AS (SELECT vec_id, avg(v) AS mu, count(*) AS n FROM x GROUP BY vec_id), c AS (SELECT vec_id, sqrt(sum((v - mu) ** 2) / (n - 1)) AS std, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, avg((v - mu) ** 3) / avg((v - mu) ** 2) ** 1.5 AS skew, avg((v - mu) ** 4) / avg((v - mu) ** 2) ** 2 - 3 AS kurt FROM x JOIN m USING (vec_id) GROUP BY vec_id, n),
d AS (SELECT vec_id, i, v, v - lag(v) OVER w AS d1, (lead(v) OVER w > 0) <> (v > 0) AS xing FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)), e AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY vec_id ORDER BY i) AS d2, d1 * lag(d1) OVER (PARTITION BY vec_id ORDER BY i) < 0 AS turn FROM d),
h AS (SELECT vec_id, count(*) FILTER (WHERE xing) AS nzc, sqrt(var_pop(d1) / var_pop(v)) AS hmob, sqrt(var_pop(d2) / var_pop(d1)) / sqrt(var_pop(d1) / var_pop(v)) AS hcomp, log10(64) / (log10(64) + log10(64 / (64 + 0.4 * count(*) FILTER (WHERE turn)))) AS petrosian FROM e GROUP BY vec_id)
SELECT vec_id, round(std, 6) AS std, round(iqr, 6) AS iqr, round(skew, 6) AS skew, round(kurt, 6) AS kurt, nzc::DOUBLE AS nzc, round(hmob, 6) AS hmob, round(hcomp, 6) AS hcomp, round(petrosian, 6) AS petrosian FROM c JOIN h USING (vec_id)"""
)
def sig_epochs_desc(spark, folder):
    """Descriptive features of each epoch."""
    f = W.describe(F.col("a"))
    return _r(vectors(spark, folder).select("vec_id", *[c.alias(k) for k, c in f.items()]), ["vec_id"], list(f))


_STAT = {
    "mean": "avg(value)", "min": "min(value)", "max": "max(value)", "ptp": "max(value) - min(value)", "rms": "sqrt(avg(value * value))", "prop_above_zero": "avg((value >= 0)::INT)",
    "slope": "CASE WHEN count(*) > 1 THEN regr_slope(value, sample::DOUBLE) END", "covar": "CASE WHEN count(*) > 1 THEN covar_samp(value, y) END",
    "corr": "CASE WHEN count(*) > 1 AND var_pop(value) > 0 AND var_pop(y) > 0 THEN corr(value, y) END",
}


def _moving(method):
    def f(spark, folder):
        s = series(spark, folder)
        rows = W.moving(s, ["user_id"], "sample", "value", "n", 1.0, 5.0, 2.0, method, "y" if method in ("covar", "corr") else None)
        return _r(rows, ["user_id", "window", "t"], ["value"], 5)

    f.__name__ = f"sig_moving_{method}"
    query(
        f""", k AS (SELECT user_id, n, unnest(range(0, ((n + 1) // 2)::BIGINT)) AS win FROM (SELECT DISTINCT user_id, n FROM u)), b AS (SELECT user_id, win, n, greatest(0, trunc(win * 2 - 2.5)::BIGINT) AS lo, least(n, trunc(win * 2 + 2.5)::BIGINT) AS hi FROM k)
SELECT b.user_id, win AS "window", (lo + hi) / 2 AS t, round(({_STAT[method]})::DOUBLE, 5) AS value FROM b JOIN u ON u.user_id = b.user_id AND u.sample >= lo AND u.sample < hi GROUP BY b.user_id, win, lo, hi"""
    )(f)


for _m in W.MOVING:
    _moving(_m)


@query(", k AS (SELECT user_id, unnest(range(0, ((n - 10) // 5 + 1)::BIGINT)) AS win FROM (SELECT DISTINCT user_id, n FROM u WHERE n >= 10)) SELECT k.user_id, win AS \"window\", count(*) AS n_samples, round(avg(value), 6) AS mean FROM k JOIN u ON u.user_id = k.user_id AND sample >= win * 5 AND sample < win * 5 + 10 GROUP BY ALL")
def sig_sliding_window(spark, folder):
    """Windows of ten samples every five."""
    rows = W.sliding(series(spark, folder), ["user_id"], "sample", 10, 5, "n")
    return rows.groupBy("user_id", "window").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT user_id, (sample // 10)::BIGINT AS epoch, round(avg(value), 6) AS mean FROM u GROUP BY ALL HAVING count(*) = 10")
def sig_epoching(spark, folder):
    """Whole tumbling windows of ten samples."""
    rows = W.epochs(series(spark, folder), ["user_id"], "sample", "value", 10)
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / 10
    return rows.select("user_id", "epoch", F.round(mean, 6).alias("mean"))


@query(", z AS (SELECT vec_id, i, v, lead(v) OVER (PARTITION BY vec_id ORDER BY i) AS w FROM x) SELECT vec_id, i::INT AS at FROM z WHERE w IS NOT NULL AND (v > 0) <> (w > 0)")
def sig_zero_crossings(spark, folder):
    return vectors(spark, folder).select("vec_id", F.explode(W.zero_crossings(F.col("a"))).alias("at"))


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM x) SELECT vec_id, round(stddev_samp(v), 6) AS sd FROM r WHERE k > 6 AND k <= 58 GROUP BY vec_id")
def sig_trimmed_sd(spark, folder):
    return vectors(spark, folder).select("vec_id", F.round(W.trimmed_sd(F.col("a")), 6).alias("sd"))


@query(", p AS (SELECT vec_id, i, v, lag(v) OVER w AS a, lead(v) OVER w AS b FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY i)) SELECT vec_id, i::INT AS at FROM p WHERE v > a AND v > b AND v BETWEEN 0.05 AND 3")
def sig_local_peaks(spark, folder):
    """Local maxima between 0.05 and 3."""
    return vectors(spark, folder).select("vec_id", F.explode(W.local_peaks(F.col("a"), 0.05, 3.0)).alias("at"))


def _bandpower_sql() -> str:
    def total(a, b):
        inside = [i for i, f in enumerate(GRID) if a <= f <= b]
        w = W.simpson_weights(len(inside), 0.5)
        return " + ".join(f"{x!r} * a[{i + 1}] * a[{i + 1}]" for i, x in zip(inside, w))

    whole = total(0.5, 30)
    return "SELECT vec_id, " + ", ".join(f"round(({total(a, b)}) / ({whole}), 6) AS {name}" for a, b, name in BANDS) + f', round({whole}, 6) AS "TotalAbsPow", 0.5::DOUBLE AS "FreqRes", true AS "Relative" FROM v'


@query(_bandpower_sql())
def sig_bandpower(spark, folder):
    """Relative band power, squared components standing for a spectrum every 0.5 Hz."""
    s = vectors(spark, folder).select("vec_id", F.transform("a", lambda x: x * x).alias("psd"))
    rows = W.band_power(s, ["vec_id"], "freqs", "psd", BANDS, GRID)
    return _r(rows, ["vec_id", "FreqRes", "Relative"], [b for _, _, b in BANDS] + ["TotalAbsPow"])


@query(", k AS (SELECT unnest(range(-7, 8)) AS k) SELECT a.user_id, a.sample, round(sum(b.value * (8 - abs(k)) / 8) / sum((8 - abs(k)) / 8), 8) AS smooth FROM u a, k JOIN u b ON b.user_id = a.user_id AND b.sample = a.sample + k GROUP BY a.user_id, a.sample")
def sig_rolling_triang(spark, folder):
    s = series(spark, folder)
    return s.select("user_id", "sample", F.round(W.triangular("value", ["user_id"], "sample"), 8).alias("smooth"))


@query("SELECT user_id, sample, round(avg(value) OVER (PARTITION BY user_id ORDER BY sample ROWS 3 PRECEDING), 6) AS smooth FROM u")
def sig_rolling_past(spark, folder):
    return series(spark, folder).select("user_id", "sample", F.round(W.trailing("value", ["user_id"], "sample"), 6).alias("smooth"))


@query("SELECT user_id, sample, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY sample ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 0) / 10, 6) AS smooth FROM u")
def sig_boxcar(spark, folder):
    return series(spark, folder).select("user_id", "sample", F.round(W.boxcar("value", ["user_id"], "sample", 10), 6).alias("smooth"))


@query(", q AS (SELECT user_id, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.95) AS c FROM u GROUP BY user_id) SELECT user_id, sample, round((value - b) / CASE WHEN c = a THEN 1 ELSE c - a END, 6) AS value FROM u JOIN q USING (user_id)")
def sig_robust_scale(spark, folder):
    rows = W.robust_scale(series(spark, folder).select("user_id", "sample", "value"), ["user_id"], ["value"])
    return rows.select("user_id", "sample", F.round("value", 6).alias("value"))


@query(
    """, p AS (SELECT user_id, sample AS s, value AS w FROM u WHERE sample % 4 = 1), q AS (SELECT u.user_id, u.sample, max(p.s) FILTER (WHERE p.s <= u.sample) AS a, min(p.s) FILTER (WHERE p.s >= u.sample) AS b FROM u LEFT JOIN p USING (user_id) GROUP BY ALL)
SELECT q.user_id, q.sample, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 WHEN a = b THEN x.w ELSE x.w + (y.w - x.w) * (q.sample - a) / (b - a) END, 6) AS value FROM q LEFT JOIN p x ON x.user_id = q.user_id AND x.s = a LEFT JOIN p y ON y.user_id = q.user_id AND y.s = b"""
)
def sig_interpolate(spark, folder):
    """Every fourth value, straight lines between, zero outside."""
    s = series(spark, folder)
    points = s.where("sample % 4 = 1").select("user_id", F.col("sample").cast("double").alias("t"), "value")
    rows = W.interpolated(points, s.select("user_id", "sample"), ["user_id"], "t", "value", "sample", 1.0)
    return rows.select("user_id", "sample", F.round("value", 6).alias("value"))


@query(
    """, e AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS epoch, a FROM v), f AS (SELECT e.label, e.vec_id, epoch, epoch % 2 AS stage, ln(stddev_pop(x.v) + 1) AS s, min(x.v) = max(x.v) AS flat FROM e JOIN x USING (vec_id) GROUP BY ALL),
g AS (SELECT *, avg(flat::INT) OVER (PARTITION BY epoch) >= 0.5 AS ef FROM f), z AS (SELECT *, (CASE WHEN NOT ef THEN s END - avg(CASE WHEN NOT ef THEN s END) OVER w) / nullif(stddev_pop(CASE WHEN NOT ef THEN s END) OVER w, 0) AS z, count(CASE WHEN NOT ef THEN s END) OVER w AS n FROM g WINDOW w AS (PARTITION BY label, stage))
SELECT epoch, stage, count(*) FILTER (WHERE abs(z) > 2 AND n >= 10) AS n_out, bool_or(ef) OR count(*) FILTER (WHERE abs(z) > 2 AND n >= 10) >= 1 AS artefact FROM z GROUP BY epoch, stage"""
)
def sig_artefact_std(spark, folder):
    """Epochs with an outlying spread in some channel (label)."""
    v = vectors(spark, folder).withColumn("epoch", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    v = v.withColumns({"stage": F.col("epoch") % 2, "rec": F.lit(1)})
    return W.artefacts(v, ["rec"], "label", "stage", "a", threshold=2.0, least_epochs=10).drop("rec")


@query(
    """, m AS (SELECT vec_id, avg(abs(v)) AS mu, stddev_samp(abs(v)) AS sd FROM x GROUP BY vec_id), s AS (SELECT vec_id, sum((abs(v) - mu) / sd * cos(v)) AS re, sum((abs(v) - mu) / sd * sin(v)) AS im FROM x JOIN m USING (vec_id) GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN re * re + im * im <= 128 * 1.9207294103 THEN 0 ELSE sqrt(re * re + im * im) / 64 END, 6) AS ndpac FROM s"""
)
def ndpac(spark, folder):
    """Coupling of a vector's components as phases with their sizes as amplitudes."""
    v = vectors(spark, folder)
    return v.select("vec_id", F.round(W.ndpac(F.col("a"), F.transform("a", F.abs)), 6).alias("ndpac"))


@query(
    """, b AS (SELECT user_id, sample * 0.8 + (event_id % 7) * 0.01 AS t, sample FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample FROM events)), r AS (SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) * 1000 AS rr, t FROM b),
q AS (SELECT *, rr - lag(rr) OVER (PARTITION BY user_id ORDER BY t) AS d FROM r WHERE rr IS NOT NULL) SELECT user_id, count(*) + 1 AS n_beats, round(avg(60000 / rr), 6) AS hr_mean, round(stddev_samp(60000 / rr), 6) AS hr_std, round(sqrt(avg(d * d)), 6) AS hrv_rmssd FROM q GROUP BY user_id"""
)
def hrv_rmssd(spark, folder):
    """Heart-rate variability of a user's events set about 0.8 s apart."""
    rows = heart.variability(_beats(spark, folder).withColumn("duration", F.lit(1.0)), ["user_id"])
    return _r(rows, ["user_id", "n_beats"], ["hr_mean", "hr_std", "hrv_rmssd"])


def _beats(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select("user_id", ((F.row_number().over(w) - 1) * 0.8 + (F.col("event_id") % 7) * 0.01).alias("beat"))


def _periods(beats: DataFrame, width: float) -> DataFrame:
    """Each user's periods of ``width`` seconds, from 0 to the one of the last beat."""
    last = beats.groupBy("user_id").agg(F.max("beat").alias("last"))
    periods = last.select("user_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / width).cast("int"))).alias("period"))
    return periods.withColumns({"start": F.col("period") * width, "duration": F.lit(width)})


@query(
    """, b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.8 + (event_id % 7) * 0.01 AS t FROM events), p AS (SELECT user_id, k AS period, k * 20.0 AS s FROM (SELECT user_id, floor(max(t) / 20)::INT AS last FROM b GROUP BY user_id), unnest(range(0, last + 1)) AS g(k))
SELECT p.user_id, period, count(*) AS n_beats FROM p JOIN b ON b.user_id = p.user_id AND t >= s AND t < s + 20 GROUP BY ALL"""
)
def hrv_beats(spark, folder):
    """Beats in periods of 20 s."""
    b = _beats(spark, folder)
    return heart.beats_in_periods(b, _periods(b, 20.0), ["user_id"], "beat", "start", "duration").groupBy("user_id", "period").agg(F.count(F.lit(1)).alias("n_beats"))


@query(
    """, b AS (SELECT user_id, t + CASE WHEN floor(t)::INT % 5 = 0 THEN 1.7 ELSE 0 END AS t FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.8::DOUBLE + (event_id % 7) * 0.01::DOUBLE AS t FROM events)),
p AS (SELECT user_id, k AS period, k * 30.0::DOUBLE AS s FROM (SELECT user_id, floor(max(t) / 30)::INT AS last FROM b GROUP BY user_id), unnest(range(0, last + 1)) AS g(k)),
m AS (SELECT p.user_id, period, t, row_number() OVER w AS i, (t - lag(t) OVER w) * 1000 AS raw FROM p JOIN b ON b.user_id = p.user_id AND t >= s AND t < s + 30 WINDOW w AS (PARTITION BY p.user_id, period ORDER BY t)),
vf AS (SELECT *, CASE WHEN raw BETWEEN 400 AND 2000 THEN raw END AS rr, CASE WHEN raw BETWEEN 400 AND 2000 THEN i END AS ri FROM m WHERE i > 1),
g AS (SELECT *, last_value(rr IGNORE NULLS) OVER a AS pv, last_value(ri IGNORE NULLS) OVER a AS pi, first_value(rr IGNORE NULLS) OVER z AS nv, first_value(ri IGNORE NULLS) OVER z AS ni FROM vf WINDOW a AS (PARTITION BY user_id, period ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id, period ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, CASE WHEN rr IS NOT NULL THEN rr WHEN coalesce(i - pi <= 10, false) OR coalesce(ni - i <= 10, false) THEN CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END END AS q FROM g),
d AS (SELECT *, q - lag(q) OVER (PARTITION BY user_id, period ORDER BY i) AS dd FROM f),
st AS (SELECT user_id, period, count(*) FILTER (WHERE q IS NULL) AS bad, avg(60000 / q) AS hm, stddev_samp(60000 / q) AS hs, sqrt(avg(dd * dd)) AS rm FROM d GROUP BY ALL),
c AS (SELECT user_id, period, count(*) AS n FROM m GROUP BY ALL)
SELECT user_id, period, n AS n_beats, CASE WHEN bad = 0 AND 2 * n >= 30 THEN round(hm, 6) END AS hr_mean, CASE WHEN bad = 0 AND 2 * n >= 30 THEN round(hs, 6) END AS hr_std, CASE WHEN bad = 0 AND 2 * n >= 30 THEN round(rm, 6) END AS hrv_rmssd FROM c LEFT JOIN st USING (user_id, period)"""
)
def hrv_rr_filter(spark, folder):
    """The same by period, one interval in five far out and interpolated."""
    b = _beats(spark, folder).withColumn("beat", F.col("beat") + F.when(F.floor("beat") % 5 == 0, 1.7).otherwise(0.0))
    met = heart.beats_in_periods(b, _periods(b, 30.0), ["user_id"], "beat", "start", "duration")
    return _r(heart.variability(met, ["user_id", "period"]), ["user_id", "period", "n_beats"], ["hr_mean", "hr_std", "hrv_rmssd"])


@query("WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY loaded_at DESC) AS rn FROM hrv_stage) WHERE rn = 1) SELECT period_id, (row_number() OVER (PARTITION BY recording_id, stage ORDER BY start, period_id) - 1)::INT AS nth FROM h".replace("WITH h", ", h"))
def hrv_numbered(spark, folder):
    """Each period's number within its recording and stage."""
    from ..tables import latest

    h = latest(table(spark, folder, "hrv_stage"), ["period_id"], "loaded_at", ["recording_id", "stage", "start"])
    w = Window.partitionBy("recording_id", "stage").orderBy("start", "period_id")
    return h.select("period_id", (F.row_number().over(w) - 1).alias("nth"))
