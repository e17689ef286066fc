"""Named queries on hypnograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hypnogram as H
from ..operators.agreement import paired_ends
from ..stages import LABELS, label_of
from . import base
from .base import KEYS, five_stage, hypnograms, sessions
from .prep import INSTANTS_SQL, instants

QUERIES, SQL = {}, {}
_EPOCHS5 = "(300 / freq_sec)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base.SQL + sql
        return f

    return add


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    ses = sessions(spark, folder).select(*KEYS, "n_stages", "freq_sec")
    h = hypnograms(spark, folder).join(ses, KEYS)
    return h.withColumn("label", label_of(F.col("code"), F.col("n_stages")))


@query("SELECT session_id, scorer, epoch, hyp.code, label AS stage FROM hyp JOIN ses USING (session_id, scorer) JOIN lab ON lab.n_stages = ses.n_stages AND lab.code = hyp.code")
def hyp_encode(spark, folder):
    """Codes and canonical labels of every epoch."""
    return _labelled(spark, folder).where("label is not null").select(*KEYS, "epoch", "code", F.col("label").alias("stage"))


@query("SELECT session_id, scorer, (max(epoch) + 1 - count(DISTINCT epoch))::BIGINT AS n_gaps, (count(epoch) - count(DISTINCT epoch))::BIGINT AS n_repeats, count(*) FILTER (WHERE code IS NULL OR code NOT IN (0,1,2,3,4,-1,-2))::BIGINT AS n_foreign FROM one GROUP BY ALL HAVING n_gaps > 0 OR n_repeats > 0 OR n_foreign > 0")
def hyp_violations(spark, folder):
    """Hypnograms as delivered that break an invariant."""
    return H.violations(base.scored(spark, folder), KEYS)


@query("SELECT hypno_id, session_id, scorer, n_stages, freq_sec, 1 / freq_sec AS sampling_frequency, n_epochs, n_epochs * freq_sec / 60 AS duration_min FROM ses JOIN (SELECT session_id, scorer, count(*) AS n_epochs FROM hyp GROUP BY ALL) USING (session_id, scorer)")
def hyp_properties(spark, folder):
    """Length, epoch length and duration of every hypnogram."""
    n = hypnograms(spark, folder).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_epochs"))
    return sessions(spark, folder).join(n, KEYS).select("hypno_id", *KEYS, "n_stages", "freq_sec", (1 / F.col("freq_sec")).alias("sampling_frequency"), "n_epochs", (F.col("n_epochs") * F.col("freq_sec") / 60).alias("duration_min"))


_RUNS = """, marked AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, scorer ORDER BY epoch) AS r FROM (SELECT *, code IS DISTINCT FROM lag(code) OVER w AS new FROM hyp WINDOW w AS (PARTITION BY session_id, scorer ORDER BY epoch))),
runs AS (SELECT session_id, scorer, any_value(code) AS value, min(epoch) AS start, count(*)::INT AS length FROM marked GROUP BY session_id, scorer, r)
"""


@query(_RUNS + "SELECT * FROM runs")
def hyp_periods(spark, folder):
    """Runs of one stage."""
    return H.runs(hypnograms(spark, folder), KEYS)


@query(_RUNS + "SELECT * FROM runs WHERE length >= 10")
def hyp_periods_long(spark, folder):
    """Runs of ten epochs or more."""
    return H.runs(hypnograms(spark, folder), KEYS, least=10)


@query(_RUNS + "SELECT session_id, scorer, value, (start + 4 * k)::INT AS start, 4 AS length FROM runs, unnest(range(0, length // 4)) AS t(k)")
def hyp_periods_equal(spark, folder):
    """Runs cut into pieces of four epochs."""
    return H.runs(hypnograms(spark, folder), KEYS, least=4, equal_length=True)


_PAIRS = """, pairs AS (SELECT session_id, scorer, code AS f, lead(code) OVER (PARTITION BY session_id, scorer ORDER BY epoch) AS t FROM hyp),
tr AS (SELECT session_id, scorer, f AS "from", t AS "to", count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY session_id, scorer, f) AS p FROM pairs WHERE t IS NOT NULL GROUP BY session_id, scorer, f, t)
"""


@query(_PAIRS + 'SELECT session_id, scorer, "from", "to", n FROM tr')
def hyp_transition_counts(spark, folder):
    return H.transitions(hypnograms(spark, folder), KEYS).drop("p")


@query(_PAIRS + 'SELECT session_id, scorer, "from", "to", round(p, 9) AS p FROM tr')
def hyp_transition_probs(spark, folder):
    return H.transitions(hypnograms(spark, folder), KEYS).select(*KEYS, "from", "to", F.round("p", 9).alias("p"))


@query(_PAIRS + 'SELECT session_id, scorer, round(avg(s), 9) AS stability FROM (SELECT session_id, scorer, "from", sum(CASE WHEN "from" = "to" THEN p ELSE 0 END) AS s FROM tr GROUP BY ALL) GROUP BY ALL')
def stage_stability(spark, folder):
    return H.stability(hypnograms(spark, folder), KEYS).withColumn("stability", F.round("stability", 9))


_STATS = """, w AS (SELECT *, lead(code) OVER o AS nxt, row_number() OVER o AS i, sum(CASE WHEN code > 0 THEN 1 ELSE 0 END) OVER o AS rk FROM five WINDOW o AS (PARTITION BY session_id, scorer ORDER BY epoch)),
x AS (SELECT *, CASE WHEN code > 0 THEN count(*) FILTER (WHERE code > 0) OVER (PARTITION BY session_id, scorer, CASE WHEN code > 0 THEN i - rk END) END AS len FROM w),
a AS (SELECT session_id, scorer, max(freq_sec) / 60 AS m, count(*) AS tib, min(epoch) FILTER (WHERE code > 0) AS f, max(epoch) FILTER (WHERE code > 0) AS l, count(*) FILTER (WHERE code > 0) AS tst,
 count(*) FILTER (WHERE code = 0) AS c0, count(*) FILTER (WHERE code = 1) AS c1, count(*) FILTER (WHERE code = 2) AS c2, count(*) FILTER (WHERE code = 3) AS c3, count(*) FILTER (WHERE code = 4) AS c4, count(*) FILTER (WHERE code = -1) AS ca, count(*) FILTER (WHERE code = -2) AS cu,
 min(epoch) FILTER (WHERE code = 1) AS l1, min(epoch) FILTER (WHERE code = 2) AS l2, min(epoch) FILTER (WHERE code = 3) AS l3, min(epoch) FILTER (WHERE code = 4) AS l4,
 count(*) FILTER (WHERE code > 0 AND nxt = 0) AS frag, min(epoch) FILTER (WHERE code > 0 AND len * freq_sec >= 300) AS s5 FROM x GROUP BY session_id, scorer),
b AS (SELECT session_id, scorer, count(*) FILTER (WHERE code = 0) AS waso FROM x JOIN (SELECT session_id, scorer, f, l FROM a) USING (session_id, scorer) WHERE epoch BETWEEN f AND l GROUP BY ALL),
st AS (SELECT session_id, scorer, tib * m AS TIB, coalesce((l - f + 1) * m, 0.0) AS SPT, CASE WHEN tst > 0 THEN waso * m END AS WASO, tst * m AS TST, f * m AS SOL, s5 * m AS SOL_5min, c0 * m AS WAKE, c1 * m AS N1, c2 * m AS N2, c3 * m AS N3, c4 * m AS REM, (c1 + c2 + c3) * m AS NREM, ca * m AS ART, cu * m AS UNS,
 l1 * m AS Lat_N1, l2 * m AS Lat_N2, l3 * m AS Lat_N3, l4 * m AS Lat_REM, 100.0 * c1 / nullif(tst, 0) AS pct_N1, 100.0 * c2 / nullif(tst, 0) AS pct_N2, 100.0 * c3 / nullif(tst, 0) AS pct_N3, 100.0 * c4 / nullif(tst, 0) AS pct_REM, 100.0 * (c1 + c2 + c3) / nullif(tst, 0) AS pct_NREM,
 tst * m * 100 / (tib * m) AS SE, CASE WHEN tst > 0 THEN tst * m * 100 / ((l - f + 1) * m) END AS SME, frag / nullif(tst * m / 60, 0) AS SFI_per_hour, frag / nullif(tst * m / 60, 0) * m AS SFI FROM a LEFT JOIN b USING (session_id, scorer))
"""
_ROUNDED = "SELECT session_id, scorer, round_even(COLUMNS(* EXCLUDE (session_id, scorer))::DOUBLE, 4) FROM st"


@query(_STATS + _ROUNDED)
def hyp_sleep_stats(spark, folder):
    """Sleep statistics of every five-stage hypnogram."""
    return H.sleep_statistics(five_stage(spark, folder), KEYS)


_LEGACY = ("TIB", "SPT", "WASO", "TST", "N1", "N2", "N3", "REM", "NREM", "SOL", "Lat_N1", "Lat_N2", "Lat_N3", "Lat_REM", "pct_N1", "pct_N2", "pct_N3", "pct_REM", "pct_NREM", "SE", "SME")


@query(_STATS + f"SELECT session_id, scorer, {', '.join(f'round_even({c}::DOUBLE, 4) AS {c}' for c in _LEGACY)} FROM st")
def hyp_sleep_stats_legacy(spark, folder):
    """The older set of statistics."""
    return H.sleep_statistics(five_stage(spark, folder), KEYS).select(*KEYS, *_LEGACY)


@query("SELECT session_id, scorer, code, count(*) * max(freq_sec) / 60 AS minutes FROM hyp JOIN ses USING (session_id, scorer) GROUP BY ALL")
def hyp_stage_minutes(spark, folder):
    h = hypnograms(spark, folder).join(sessions(spark, folder).select(*KEYS, "freq_sec"), KEYS)
    return H.stage_minutes(h, KEYS)


def _consolidated(n):
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in H.MERGED[n].items())
    names = " ".join(f"WHEN {v} THEN '{k}'" for k, v in LABELS[n].items())

    def f(spark, folder):
        h = H.consolidate(five_stage(spark, folder).drop("freq_sec"), n)
        return h.withColumn("stage", label_of(F.col("code"), n))

    f.__name__ = f"hyp_consolidate_{n}"
    query(f"SELECT *, CASE code {names} END AS stage FROM (SELECT session_id, scorer, epoch, CASE code {cases} END::INT AS code FROM five)")(f)


for _n in (4, 3, 2):
    _consolidated(_n)


@query("SELECT session_id, scorer, (epoch * 3 + k)::INT AS epoch, code FROM hyp, unnest(range(0, 3)) AS t(k)")
def hyp_upsample(spark, folder):
    """Epochs a third as long."""
    return H.upsample(hypnograms(spark, folder), 3)


@query(", e AS (SELECT session_id, scorer, max(epoch) AS n FROM hyp GROUP BY ALL) SELECT session_id, scorer, (epoch + 2)::INT AS epoch, code FROM hyp UNION ALL SELECT session_id, scorer, k::INT, -2 FROM e, unnest(range(0, 2)) AS t(k) UNION ALL SELECT session_id, scorer, (n + 3 + k)::INT, -2 FROM e, unnest(range(0, 1)) AS t(k)")
def hyp_pad(spark, folder):
    """Two unscored epochs before, one after."""
    return H.pad(hypnograms(spark, folder), KEYS, 2, 1)


@query(", e AS (SELECT session_id, scorer, max(epoch) AS n, arg_min(code, epoch) AS f, arg_max(code, epoch) AS l FROM hyp GROUP BY ALL) SELECT session_id, scorer, (epoch + 1)::INT AS epoch, code FROM hyp UNION ALL SELECT session_id, scorer, 0, f FROM e UNION ALL SELECT session_id, scorer, (n + 2)::INT, l FROM e")
def hyp_pad_edge(spark, folder):
    """The first and last stage once more."""
    return H.pad(hypnograms(spark, folder), KEYS, 1, 1, "edge")


@query("SELECT session_id, scorer, (epoch - 20)::INT AS epoch, code FROM hyp WHERE epoch BETWEEN 20 AND 119")
def hyp_crop(spark, folder):
    return H.crop(hypnograms(spark, folder), 20, 119)


@query(", e AS (SELECT *, max(epoch) OVER (PARTITION BY session_id, scorer) + 1 AS n FROM hyp) SELECT session_id, scorer, (epoch - greatest(n - 50, 0))::INT AS epoch, code FROM e WHERE epoch >= greatest(n - 50, 0) AND epoch < n - 10")
def hyp_slice(spark, folder):
    """The fiftieth epoch from the end up to the tenth."""
    return H.part(hypnograms(spark, folder), KEYS, -50, -10)


@query("SELECT session_id, scorer, epoch, code IN (2, 3) AS mask FROM hyp")
def hyp_mask(spark, folder):
    """Which epochs are N2 or N3."""
    return hypnograms(spark, folder).select(*KEYS, "epoch", F.col("code").isin(2, 3).alias("mask"))


@query("SELECT session_id, scorer, epoch, epoch * freq_sec AS onset, freq_sec AS duration, hyp.code AS value, label AS description FROM hyp JOIN ses USING (session_id, scorer) LEFT JOIN lab ON lab.n_stages = ses.n_stages AND lab.code = hyp.code")
def hyp_as_events(spark, folder):
    rows = H.events(_labelled(spark, folder), F.col("freq_sec"), F.col("label"))
    return rows.select(*KEYS, "epoch", "onset", "duration", "value", "description")


@query(", p AS (SELECT session_id, min(scorer) AS a, max(scorer) AS b FROM span GROUP BY ALL HAVING min(scorer) <> max(scorer)), e AS (SELECT session_id, epoch, max(code) FILTER (WHERE scorer = a) AS x, max(code) FILTER (WHERE scorer = b) AS y FROM hyp JOIN p USING (session_id) GROUP BY ALL) SELECT session_id, epoch, x = y AS equal FROM e WHERE x IS NOT NULL AND y IS NOT NULL")
def hyp_equal(spark, folder):
    """Epochs on which a session's first and last scorer agree."""
    pairs = paired_ends(hypnograms(spark, folder), "session_id", "scorer")
    return pairs.select("session_id", "epoch", (F.col("ref") == F.col("obs")).alias("equal"))


def hyp_align_offset(spark, folder):
    """Epochs by which each recording starts after its hypnogram; null where a start names no instant."""
    when = instants(spark, folder)
    rows = sessions(spark, folder).join(when.select(F.col("rec_id").alias("hypno_id"), F.col("utc_us").alias("h")), "hypno_id", "left")
    rows = rows.join(when.select(F.col("rec_id").alias("recording_id"), F.col("utc_us").alias("r")), "recording_id", "left")
    return rows.withColumn("a", H.alignment(F.col("r"), F.col("h"), F.col("freq_sec"))).select("hypno_id", "recording_id", "a.offset", "a.off_grid")


QUERIES["hyp_align_offset"] = hyp_align_offset
SQL["hyp_align_offset"] = (
    INSTANTS_SQL
    + """, o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, scorer ORDER BY loaded_at DESC, hypno_id DESC) AS rn FROM sleep_session) WHERE rn = 1),
g AS (SELECT hypno_id, recording_id, freq_sec, (r.utc_us - h.utc_us) / 1000000.0::DOUBLE / freq_sec AS n FROM o LEFT JOIN at_ h ON h.rec_id = hypno_id LEFT JOIN at_ r ON r.rec_id = recording_id)
SELECT hypno_id, recording_id, round_even(n, 0)::INT AS "offset", abs(n - round_even(n, 0)) > 1e-6 AS off_grid FROM g"""
)


@query(", d AS (SELECT DISTINCT recording_id, channel, event_id, negpeak FROM sw_event WHERE negpeak IS NOT NULL), f AS (SELECT session_id, any_value(recording_id) AS recording_id, min(scorer) AS scorer FROM ses GROUP BY session_id), s AS (SELECT f.recording_id, f.session_id, f.scorer, ses.freq_sec FROM f JOIN ses USING (session_id, scorer)) SELECT event_id, d.recording_id, coalesce(hyp.code, -2)::INT AS code FROM d JOIN s ON s.recording_id = d.recording_id LEFT JOIN hyp ON hyp.session_id = s.session_id AND hyp.scorer = s.scorer AND hyp.epoch = floor(negpeak / freq_sec)::INT")
def hyp_at_events(spark, folder):
    """Stage of each slow wave by the recording's first scorer, unscored beyond the hypnogram."""
    from ..operators import events as E
    from ..tables import table

    ses = sessions(spark, folder)
    first = ses.groupBy("session_id").agg(F.max("recording_id").alias("recording_id"), F.min("scorer").alias("scorer"))
    s = first.join(ses.select(*KEYS, "freq_sec"), KEYS)
    waves = table(spark, folder, "sw_event").where("negpeak is not null").select("recording_id", "channel", "event_id", "negpeak").distinct()
    placed = waves.join(s, "recording_id")
    return E.at_stage(placed, hypnograms(spark, folder), KEYS, F.col("negpeak"), F.col("freq_sec")).select("event_id", "recording_id", "code")


@query("SELECT session_id, scorer, code, epoch, (row_number() OVER (PARTITION BY session_id, scorer, code ORDER BY epoch) - 1)::INT AS nth FROM hyp")
def hyp_numbered(spark, folder):
    """Each epoch's number within its stage."""
    w = Window.partitionBy(*KEYS, "code").orderBy("epoch")
    return hypnograms(spark, folder).withColumn("nth", F.row_number().over(w) - 1)


@query("""SELECT session_id, scorer, '{"values":[' || string_agg('"' || label || '"', ',' ORDER BY epoch) || '],"n_stages":' || any_value(ses.n_stages) || ',"freq":"' || any_value(freq_sec::INT) || 's","start":' || coalesce('"' || any_value(recording_id) || '"', 'null') || ',"scorer":"' || scorer || '","proba":null}' AS json FROM hyp JOIN ses USING (session_id, scorer) JOIN lab ON lab.n_stages = ses.n_stages AND lab.code = hyp.code GROUP BY session_id, scorer""")
def hyp_to_json(spark, folder):
    """Each hypnogram as one JSON object (its start is the recording's id here, as written starts need escapes)."""
    ses = sessions(spark, folder).select(*KEYS, "n_stages", "freq_sec", F.col("recording_id").alias("start"), F.col("scorer").alias("scorer_name"))
    labelled = _labelled(spark, folder).where("label is not null").select(*KEYS, "epoch", "code")
    return H.as_json(labelled, KEYS, ses)


@query("SELECT session_id, scorer, epoch, label AS stage FROM hyp JOIN ses USING (session_id, scorer) JOIN lab ON lab.n_stages = ses.n_stages AND lab.code = hyp.code")
def hyp_from_json(spark, folder):
    """The way back from JSON."""
    return H.from_json(hyp_to_json(spark, folder), "json", KEYS).select(*KEYS, F.col("epoch"), F.col("label").alias("stage"))
