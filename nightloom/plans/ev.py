"""Named queries on event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..tables import latest, table
from . import base

QUERIES, SQL = {}, {}
_SP = ["recording_id", "channel", "start", "peak", "duration", "amplitude", "rms", "frequency", "symmetry", "oscillations", "stage"]
_SW = ["recording_id", "channel", "start", "negpeak", "midcrossing", "pospeak", "duration", "valnegpeak", "valpospeak", "ptp", "slope", "frequency", "stage"]

_VIEWS = """WITH sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn FROM spindle_event) WHERE rn = 1),
sw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn FROM sw_event) WHERE rn = 1)
"""


def query(sql: str | None, prefix: str = _VIEWS):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = prefix + sql
        return f

    return add


def spindles(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "spindle_event"), ["event_id"], "loaded_at", _SP)


def waves(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "sw_event"), ["event_id"], "loaded_at", _SW)


def _rounded(df: DataFrame, keep, cols, digits=6) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in cols])


def _aggs(names, fn="avg"):
    return ", ".join(f"round({fn}({c})::DOUBLE, 6) AS {c}" for c in names)


_SPN = ["duration", "amplitude", "rms", "frequency", "symmetry", "oscillations"]
_SWN = ["duration", "valnegpeak", "valpospeak", "ptp", "slope", "frequency"]


@query(f"SELECT stage, channel, count(*) AS \"Count\", {_aggs(_SPN)} FROM sp GROUP BY ALL")
def ev_summary_stage(spark, folder):
    """Mean spindle by stage and channel."""
    return _rounded(E.summary(spindles(spark, folder), ["stage", "channel"], _SPN), ["stage", "channel", "Count"], _SPN)


@query(f"SELECT recording_id, channel, count(*) AS \"Count\", {_aggs(_SWN, 'median')} FROM sw GROUP BY ALL")
def ev_summary_median(spark, folder):
    """Median slow wave by recording and channel."""
    return _rounded(E.summary(waves(spark, folder), ["recording_id", "channel"], _SWN, "median"), ["recording_id", "channel", "Count"], _SWN)


@query("SELECT event_id, recording_id, channel, start, duration FROM sp WHERE frequency > 13 AND duration >= 0.7")
def ev_mask(spark, folder):
    """Fast, long spindles: a masked event table without groups."""
    mask = (F.col("frequency") > 13) & (F.col("duration") >= 0.7)
    return E.summary(spindles(spark, folder), [], [], mask=mask).select("event_id", "recording_id", "channel", "start", "duration")


_FIRST = """, f AS (SELECT session_id, max(recording_id) AS recording_id, min(scorer) AS scorer FROM ses GROUP BY session_id),
mins AS (SELECT recording_id, hyp.code AS stage, count(*) * max(freq_sec) / 60 AS minutes FROM f JOIN ses USING (session_id, scorer) JOIN hyp USING (session_id, scorer) GROUP BY f.recording_id, hyp.code)
"""


@query(_FIRST.replace("max(recording_id) AS recording_id", "max(ses.recording_id) AS recording_id").replace("SELECT recording_id, hyp.code", "SELECT f.recording_id, hyp.code") + ", n AS (SELECT recording_id, stage, count(DISTINCT event_id) AS \"Count\" FROM spindle_event GROUP BY ALL) SELECT n.recording_id, n.stage, \"Count\", round(\"Count\" / minutes, 9) AS \"Density\" FROM n LEFT JOIN mins ON mins.recording_id = n.recording_id AND mins.stage = n.stage", base.SQL)
def ev_density(spark, folder):
    """Spindles per minute of each stage, by the recording's first scorer."""
    ses = base.sessions(spark, folder)
    first = ses.groupBy("session_id").agg(F.max("recording_id").alias("recording_id"), F.min("scorer").alias("scorer"))
    h = base.hypnograms(spark, folder).join(first, base.KEYS).join(ses.select(*base.KEYS, "freq_sec"), base.KEYS)
    minutes = h.groupBy("recording_id", F.col("code").alias("stage")).agg((F.count(F.lit(1)) * F.max("freq_sec") / 60).alias("minutes"))
    n = E.summary(spindles(spark, folder), ["recording_id", "stage"], [])
    return E.density(n, minutes, ["recording_id", "stage"]).withColumn("Density", F.round("Density", 9))


@query("SELECT recording_id, count(*) AS \"Count\", round(atan2(sum(sin(2 * pi() * symmetry)), sum(cos(2 * pi() * symmetry))), 6) AS phase FROM sp GROUP BY ALL")
def ev_circmean(spark, folder):
    """Circular mean of an angle, spindle symmetry on the circle."""
    rows = spindles(spark, folder).withColumn("phase", 2 * F.pi() * F.col("symmetry"))
    return _rounded(E.summary(rows, ["recording_id"], ["phase"], circular=["phase"]), ["recording_id", "Count"], ["phase"])


@query(", a AS (SELECT *, count(*) OVER (PARTITION BY recording_id, channel, start) AS n FROM sw), b AS (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY recording_id, channel, start + duration) AS n FROM a WHERE n = 1) SELECT event_id FROM b WHERE n = 1")
def ev_dedup_keepfalse(spark, folder):
    """Slow waves whose start, then end, no other wave of the channel shares."""
    rows = waves(spark, folder).withColumn("end", F.col("start") + F.col("duration"))
    return E.drop_repeated(rows, ["recording_id", "channel"], ["start", "end"]).select("event_id")


@query(", a AS (SELECT *, count(*) OVER (PARTITION BY recording_id, round_even(start, 0)) AS ns, count(*) OVER (PARTITION BY recording_id, round_even(start + duration, 0)) AS ne FROM sp) SELECT event_id FROM a WHERE ns > 1 OR ne > 1")
def ev_multi_only(spark, folder):
    """Spindles seen at nearly the same time more than once in a recording."""
    return E.on_several(spindles(spark, folder), ["recording_id"], "start", F.col("start") + F.col("duration")).select("event_id")


@query(""", p AS (SELECT DISTINCT recording_id, channel, floor(start)::BIGINT AS s FROM sp WHERE start IS NOT NULL), g AS (SELECT *, s - lag(s) OVER (PARTITION BY recording_id, channel ORDER BY s) AS d FROM p),
k AS (SELECT *, sum(CASE WHEN d > 1 AND d >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, channel ORDER BY s) AS r FROM g) SELECT recording_id, channel, min(s) AS start, max(s) AS stop FROM k GROUP BY recording_id, channel, r""")
def ev_merge_close(spark, folder):
    """Trains of spindles less than a minute apart."""
    p = spindles(spark, folder).where("start is not null").select("recording_id", "channel", F.floor("start").alias("s")).distinct()
    return E.merge_close(p, ["recording_id", "channel"], "s", 60)


@query("SELECT DISTINCT recording_id, channel, unnest(range(floor(start * 10)::BIGINT, floor((start + duration) * 10)::BIGINT + 1)) AS sample FROM sp WHERE start IS NOT NULL AND duration >= 0")
def ev_samples(spark, folder):
    """Every tenth of a second inside a spindle."""
    return E.samples_of(spindles(spark, folder), ["recording_id", "channel"], F.col("start"), F.col("start") + F.col("duration"), 10.0)


_DECI = ", d AS (SELECT DISTINCT recording_id, channel, round_even(start * 10, 0)::BIGINT AS t FROM sp WHERE start IS NOT NULL), g AS (SELECT DISTINCT recording_id, channel, round_even(negpeak * 10, 0)::BIGINT AS t FROM sw WHERE negpeak IS NOT NULL)"


@query(
    _DECI
    + """, a AS (SELECT d.recording_id, d.channel, count(*) FILTER (WHERE hit) AS tp, count(*) FILTER (WHERE NOT hit) AS fp FROM (SELECT d.*, EXISTS (SELECT 1 FROM g WHERE g.recording_id = d.recording_id AND g.channel = d.channel AND abs(g.t - d.t) <= 5) AS hit FROM d) d GROUP BY ALL),
b AS (SELECT g.recording_id, g.channel, count(*) FILTER (WHERE NOT hit) AS fn FROM (SELECT g.*, EXISTS (SELECT 1 FROM d WHERE g.recording_id = d.recording_id AND g.channel = d.channel AND abs(g.t - d.t) <= 5) AS hit FROM g) g GROUP BY ALL),
m AS (SELECT recording_id, channel, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM a FULL JOIN b USING (recording_id, channel)),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM m)
SELECT recording_id, channel, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"""
)
def ev_compare_detection(spark, folder):
    """Spindle starts against slow waves' peaks, half a second apart at most."""
    d = spindles(spark, folder).withColumn("t", E.deciseconds(F.col("start")))
    g = waves(spark, folder).withColumn("t", E.deciseconds(F.col("negpeak")))
    m = E.compare(d, g, ["recording_id", "channel"], "t", 5)
    return _rounded(m, ["recording_id", "channel", "tp", "fp", "fn"], ["precision", "recall", "f1"], 9)


@query(
    """, e AS (SELECT DISTINCT recording_id, channel AS c, round_even(start * 10, 0)::BIGINT AS t FROM sp WHERE start IS NOT NULL), n AS (SELECT recording_id, c, count(*) AS n FROM e GROUP BY ALL),
met AS (SELECT x.recording_id, x.c AS truth, y.c AS detected, count(DISTINCT y.t) AS tp, count(DISTINCT x.t) AS hit FROM e x JOIN e y ON x.recording_id = y.recording_id AND abs(x.t - y.t) <= 3 GROUP BY ALL),
m AS (SELECT a.recording_id, a.c AS truth, b.c AS detected, coalesce(tp, 0) AS tp, b.n - coalesce(tp, 0) AS fp, a.n - coalesce(hit, 0) AS fn, b.n AS nd FROM n a JOIN n b USING (recording_id) LEFT JOIN met ON met.recording_id = a.recording_id AND met.truth = a.c AND met.detected = b.c),
r AS (SELECT *, coalesce(tp / nullif(nd, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM m)
SELECT recording_id, truth, detected, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1 FROM r"""
)
def ev_compare_channels(spark, folder):
    """Spindles of every pair of channels, 0.3 s apart at most."""
    d = spindles(spark, folder).withColumn("t", E.deciseconds(F.col("start")))
    m = E.compare_channels(d, ["recording_id"], "channel", "t", 3)
    return _rounded(m, ["recording_id", "truth", "detected", "tp", "fp", "fn"], ["precision", "recall", "f1"], 9)


def _coincidence(scaled):
    value = "CASE WHEN a.c = b.c THEN 1.0 ELSE coalesce(k, 0)::DOUBLE / (a.n * b.n) END" if scaled else "coalesce(k, 0)::DOUBLE"

    def f(spark, folder):
        s = E.spans_of(spindles(spark, folder), ["recording_id", "channel"], F.col("start"), F.col("start") + F.col("duration"), 10.0)
        return E.coincidence(s, ["recording_id"], "channel", scaled).withColumn("value", F.round("value", 12))

    f.__name__ = "ev_coincidence_scaled" if scaled else "ev_coincidence"
    query(
        f""", s AS (SELECT DISTINCT recording_id, channel AS c, unnest(range(floor(start * 10)::BIGINT, floor((start + duration) * 10)::BIGINT + 1)) AS t FROM sp WHERE start IS NOT NULL AND duration >= 0),
n AS (SELECT recording_id, c, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT x.recording_id, x.c AS c1, y.c AS c2, count(*) AS k FROM s x JOIN s y USING (recording_id, t) GROUP BY ALL)
SELECT a.recording_id, a.c AS c1, b.c AS c2, round({value}, 12) AS value FROM n a JOIN n b USING (recording_id) LEFT JOIN m ON m.recording_id = a.recording_id AND m.c1 = a.c AND m.c2 = b.c"""
    )(f)


_coincidence(False)
_coincidence(True)


@query(
    """, m AS (SELECT sw.event_id, max_by(peak, sp.event_id) AS p, any_value(negpeak) AS t FROM sw JOIN sp USING (recording_id, channel) WHERE peak > negpeak - 1.2 AND peak < negpeak + 1.2 GROUP BY sw.event_id)
SELECT sw.event_id, p IS NOT NULL AS "Cooccurring", p AS "CooccurringPeak", round(p - t, 6) AS "DistanceToWave" FROM sw LEFT JOIN m USING (event_id)"""
)
def ev_cooccurring(spark, folder):
    """Slow waves with the last spindle peaking within 1.2 s on the same channel."""
    sp = spindles(spark, folder).withColumnRenamed("event_id", "rank")
    rows = E.cooccurring(waves(spark, folder), sp, ["recording_id", "channel"], "event_id", "negpeak", "peak", "rank")
    return rows.select("event_id", "Cooccurring", "CooccurringPeak", F.round("DistanceToWave", 6).alias("DistanceToWave"))


@query(
    """, x AS (SELECT DISTINCT recording_id, channel, floor(start * 10)::BIGINT AS sample FROM sp WHERE start IS NOT NULL), u AS (SELECT recording_id, channel, min(sample) AS lo, max(sample) AS hi FROM x GROUP BY ALL),
sig AS (SELECT u.recording_id, u.channel, g.s AS sample, CASE WHEN x.sample IS NULL THEN 0.0 ELSE 1.0 END AS value FROM (SELECT *, unnest(range(lo, hi + 1)) AS s FROM u) g JOIN u USING (recording_id, channel) LEFT JOIN x ON x.recording_id = g.recording_id AND x.channel = g.channel AND x.sample = g.s),
w AS (SELECT recording_id, channel, event_id, floor(negpeak * 10)::BIGINT AS c FROM sw WHERE negpeak IS NOT NULL), e AS (SELECT w.recording_id, w.channel, event_id, c, unnest(range(-4, 9)) AS k FROM w),
j AS (SELECT e.*, value, count(*) OVER (PARTITION BY e.recording_id, e.channel, event_id, c) AS n FROM e JOIN sig ON sig.recording_id = e.recording_id AND sig.channel = e.channel AND sig.sample = e.c + e.k)
SELECT channel, k AS "offset", count(*) AS n, round(avg(value), 9) AS value FROM j WHERE n = 13 GROUP BY ALL"""
)
def ev_sync_average(spark, folder):
    """Share of slow waves with a spindle starting at each tenth of a second around the negative peak."""
    by = ["recording_id", "channel"]
    x = spindles(spark, folder).where("start is not null").select(*by, F.floor(F.col("start") * 10).alias("sample")).distinct()
    u = x.groupBy(*by).agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    rows = E.locked(waves(spark, folder), x.withColumn("value", F.lit(1.0)), by, "event_id", F.col("negpeak"), 10.0, 0.4, 0.8, "value", bounds=u)
    return E.template(rows, ["channel"], "value").withColumn("value", F.round("value", 9))


@query("SELECT recording_id, channel, start AS onset, 'spindle' AS label, duration FROM sp")
def ev_annotations(spark, folder):
    """Spindles as annotations: onset, label, duration."""
    e = spindles(spark, folder)
    return e.select("recording_id", "channel", F.col("start").alias("onset"), F.lit("spindle").alias("label"), "duration")


@query("SELECT recording_id, channel FROM sp INTERSECT SELECT recording_id, channel FROM sw")
def ev_common_channels(spark, folder):
    """Channels with both kinds of event."""
    return spindles(spark, folder).select("recording_id", "channel").intersect(waves(spark, folder).select("recording_id", "channel"))


@query(
    """, p AS (SELECT recording_id, channel, event_id, negpeak AS t, 'a' AS k FROM sw WHERE negpeak IS NOT NULL UNION ALL SELECT recording_id, channel, event_id, peak, 'b' FROM sp WHERE peak IS NOT NULL),
q AS (SELECT *, min(CASE WHEN k = 'b' THEN t END) OVER (PARTITION BY recording_id, channel ORDER BY t, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, max(CASE WHEN k = 'b' THEN t END) OVER (PARTITION BY recording_id, channel ORDER BY t, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv FROM p)
SELECT event_id, nxt, prv FROM q WHERE k = 'a'"""
)
def ev_asof(spark, folder):
    """The spindle peak before and after each slow wave's negative peak."""
    a = waves(spark, folder).where("negpeak is not null").select("recording_id", "channel", "event_id", F.col("negpeak").alias("t"), F.lit("a").alias("k"))
    b = spindles(spark, folder).where("peak is not null").select("recording_id", "channel", "event_id", F.col("peak").alias("t"), F.lit("b").alias("k"))
    u = a.unionByName(b)
    by = ["recording_id", "channel"]
    rows = u.withColumns({"nxt": E.following(u, by, "t", "k", "b"), "prv": E.preceding(u, by, "t", "k", "b")})
    return rows.where("k = 'a'").select("event_id", "nxt", "prv")
