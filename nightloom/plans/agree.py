"""Named queries on the agreement of two scorers: the first and last, by name, of each session scored more than once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist
from ..operators import agreement as A
from ..operators import hypnogram as H
from ..session import bounded, cut
from . import base
from .base import KEYS
from .hyp import _STATS

QUERIES, SQL = {}, {}
_LABELS = [0, 1, 2, 3, 4, -1, -2]
STATS = ["TST", "WASO", "SOL", "N1", "N2", "N3", "REM", "SE", "SME"]

_DUO = """, duo AS (SELECT session_id, min(scorer) AS a, max(scorer) AS b FROM (SELECT DISTINCT session_id, scorer FROM five) GROUP BY session_id HAVING min(scorer) <> max(scorer)),
pr AS (SELECT d.session_id, x.epoch, x.code AS ref, y.code AS obs FROM duo d JOIN five x ON x.session_id = d.session_id AND x.scorer = d.a JOIN five y ON y.session_id = d.session_id AND y.scorer = d.b AND y.epoch = x.epoch),
cm AS (SELECT session_id, ref, obs, count(*) AS n FROM pr GROUP BY ALL)
"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base.SQL + sql
        return f

    return add


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return A.paired_ends(base.five_stage(spark, folder), "session_id", "scorer")


def _r(df: DataFrame, keep, digits: int = 8) -> DataFrame:
    return df.select(*keep, *[F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keep])


def _metrics(key: str | None) -> str:
    """SQL of the agreement metrics of counts ``k(key, ref, obs, n)``."""
    g = f"{key}, " if key else ""
    j = f"USING ({key}, c)" if key else "USING (c)"
    by = f"GROUP BY {key}" if key else ""
    over = f"PARTITION BY {key}" if key else ""
    return f"""rw AS (SELECT {g}ref AS c, sum(n) AS r, sum(n) FILTER (WHERE ref = obs) AS hit FROM k GROUP BY {g}ref), cl AS (SELECT {g}obs AS c, sum(n) AS k FROM k GROUP BY {g}obs),
per AS (SELECT {g}c, coalesce(r, 0)::DOUBLE AS r, coalesce(k, 0)::DOUBLE AS k, coalesce(hit, 0)::DOUBLE AS h FROM rw FULL JOIN cl {j}),
q AS (SELECT *, sum(r) OVER ({over}) AS n, CASE WHEN k > 0 THEN h / k ELSE 0 END AS p, CASE WHEN r > 0 THEN h / r ELSE 0 END AS re FROM per),
z AS (SELECT *, CASE WHEN p + re > 0 THEN 2 * p * re / (p + re) ELSE 0 END AS f FROM q),
s AS (SELECT {g}max(n) AS n, sum(h) AS h, sum(r * k) AS rc, sum(r * r) AS rr, sum(k * k) AS cc, avg(re) FILTER (WHERE r > 0) AS bal, sum(r * p) AS wp, sum(r * re) AS wr, sum(r * f) AS wf FROM z {by}),
m AS (SELECT {g}h / n AS accuracy, bal AS balanced_acc, (h / n - rc / (n * n)) / nullif(1 - rc / (n * n), 0) AS kappa, coalesce((n * h - rc) / nullif(sqrt((n * n - cc) * (n * n - rr)), 0), 0) AS mcc, wp / n AS precision, wr / n AS recall, wf / n AS f1 FROM s)
"""


_M = ", ".join(f"round({m}, 8) AS {m}" for m in A.METRICS)


@query(_DUO + ", l AS (SELECT unnest([0, 1, 2, 3, 4, -1, -2]) AS v) SELECT s.session_id, a.v AS ref, b.v AS obs, coalesce(n, 0) AS n FROM (SELECT DISTINCT session_id FROM pr) s, l a, l b LEFT JOIN cm ON cm.session_id = s.session_id AND cm.ref = a.v AND cm.obs = b.v")
def ebe_confusion(spark, folder):
    return A.full_confusion(pairs(spark, folder), ["session_id"], _LABELS)


@query(_DUO + ", l AS (SELECT unnest([0, 1, 2, 3, 4, -1, -2]) AS v), t AS (SELECT ref, obs, sum(n)::BIGINT AS n FROM cm GROUP BY ALL) SELECT a.v AS ref, b.v AS obs, coalesce(n, 0) AS n FROM l a, l b LEFT JOIN t ON t.ref = a.v AND t.obs = b.v")
def ebe_confusion_pooled(spark, folder):
    return A.full_confusion(pairs(spark, folder), [], _LABELS)


@query(_DUO + ", k AS (SELECT * FROM cm), " + _metrics("session_id") + f"SELECT session_id, {_M} FROM m")
def ebe_agreement(spark, folder):
    return _r(A.agreement(A.confusion(pairs(spark, folder), ["session_id"]), ["session_id"]), ["session_id"])


_EVERY = """, fst AS (SELECT session_id, min(scorer) AS a FROM five GROUP BY session_id),
k AS (SELECT x.session_id, y.scorer AS observer, x.code AS ref, y.code AS obs, count(*) AS n FROM fst JOIN five x ON x.session_id = fst.session_id AND x.scorer = fst.a JOIN five y ON y.session_id = x.session_id AND y.scorer <> fst.a AND y.epoch = x.epoch GROUP BY ALL)
"""


@query(_EVERY + ", " + _metrics("session_id, observer") + f"SELECT session_id, observer, {_M} FROM m")
def ebe_agreement_observers(spark, folder):
    """The first scorer with every other one of the session, so that no scorer's epochs are left out."""
    keys = ["session_id", "observer"]
    every = A.paired_first(base.five_stage(spark, folder), "session_id", "scorer")
    return _r(A.agreement(A.confusion(every, keys), keys), keys)


@query(_DUO + ", k AS (SELECT ref, obs, sum(n) AS n FROM cm GROUP BY ALL), " + _metrics(None) + f"SELECT {_M} FROM m")
def ebe_agreement_pooled(spark, folder):
    return _r(A.agreement(A.confusion(pairs(spark, folder))), [])


@query(_DUO + ", k AS (SELECT coalesce(session_id, '*') AS session_id, ref, obs, sum(n) AS n FROM cm GROUP BY GROUPING SETS ((session_id, ref, obs), (ref, obs))), " + _metrics("session_id") + f"SELECT nullif(session_id, '*') AS session_id, {_M} FROM m")
def ebe_agreement_with_total(spark, folder):
    return _r(A.agreement_with_total(pairs(spark, folder), "session_id"), ["session_id"])


@query(
    _DUO
    + """, k AS (SELECT * FROM cm), """
    + _metrics("session_id").split("s AS (SELECT")[0].rstrip().rstrip(",")
    + """, b AS (SELECT session_id, c, h AS tp, r - h AS fn, k - h AS fp, n - r - k + h AS tn, r FROM q), d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM b)
SELECT session_id, c AS stage, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 8) AS fbeta, round(npv, 8) AS npv, round(precision, 8) AS precision, round(recall, 8) AS recall, round(specificity, 8) AS specificity, r::BIGINT AS support FROM d"""
)
def ebe_bystage(spark, folder):
    rows = A.agreement_by_stage(A.confusion(pairs(spark, folder), ["session_id"]), ["session_id"])
    return _r(rows, ["session_id", "stage", "support"])


@query(
    _DUO
    + ", k AS (SELECT * FROM cm), "
    + _metrics("session_id")
    + ", u AS (UNPIVOT (SELECT * EXCLUDE (session_id) FROM m) ON accuracy, balanced_acc, kappa, mcc, precision, recall, f1 INTO NAME metric VALUE value), v AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS mu FROM u) SELECT metric, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS std, round(avg(abs(value - mu)), 8) AS mad, round(min(value), 8) AS min, round(median(value), 8) AS median, round(max(value), 8) AS max FROM v GROUP BY metric"
)
def ebe_summary(spark, folder):
    scores = A.agreement(A.confusion(pairs(spark, folder), ["session_id"]), ["session_id"])
    return _r(A.summarise(scores.drop("session_id")), ["metric"])


@query(_DUO + "SELECT session_id, round(avg((ref = obs)::INT), 8) AS share_equal FROM pr GROUP BY session_id")
def ebe_custom_scorer(spark, folder):
    """A user's own function of the two label arrays, session by session."""
    return _r(A.custom_scores(pairs(spark, folder), ["session_id"], {"share_equal": lambda a, b: float((a == b).mean())}), ["session_id"])


@query(
    _EVERY
    + """, """
    + _metrics("session_id, observer").split("s AS (SELECT")[0].rstrip().rstrip(",")
    + """, b AS (SELECT session_id, observer, c, h AS tp, r - h AS fn, k - h AS fp, n - r - k + h AS tn, r FROM q), d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity, coalesce(tn / nullif(tn + fn, 0), 0) AS npv FROM b)
SELECT session_id, observer, c AS stage, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 8) AS fbeta, round(npv, 8) AS npv, round(precision, 8) AS precision, round(recall, 8) AS recall, round(specificity, 8) AS specificity, r::BIGINT AS support FROM d"""
)
def ebe_bystage_observers(spark, folder):
    """Each stage's agreement of the first scorer with every other one."""
    keys = ["session_id", "observer"]
    every = A.paired_first(base.five_stage(spark, folder), "session_id", "scorer")
    return _r(A.agreement_by_stage(A.confusion(every, keys), keys), [*keys, "stage", "support"])


def stats_pair(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Sleep statistics of the first and of the last scorer: one row a hypnogram, so they are written once and read by each step."""
    stats = cut(H.sleep_statistics(base.five_stage(spark, folder), KEYS))
    ends = stats.groupBy("session_id").agg(F.min("scorer").alias("a"), F.max("scorer").alias("b")).where("a <> b")
    return tuple(stats.join(ends.select("session_id", F.col(c).alias("scorer")), KEYS).drop("scorer") for c in ("a", "b"))


def differences(spark: SparkSession, folder: str) -> DataFrame:
    return A.differences(*stats_pair(spark, folder), "session_id", STATS)


_DIFF = (
    _STATS
    + _DUO
    + f""", ro AS (SELECT session_id, scorer, {', '.join(f'round_even({c}::DOUBLE, 4) AS {c}' for c in STATS)} FROM st),
lg AS (UNPIVOT ro ON {', '.join(STATS)} INTO NAME sleep_stat VALUE value),
df AS (SELECT x.sleep_stat, d.session_id, x.value AS ref, y.value AS obs, y.value - x.value AS difference FROM duo d JOIN lg x ON x.session_id = d.session_id AND x.scorer = d.a JOIN lg y ON y.session_id = d.session_id AND y.scorer = d.b AND y.sleep_stat = x.sleep_stat WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
di AS (SELECT * FROM df WHERE sleep_stat IN (SELECT sleep_stat FROM df GROUP BY sleep_stat HAVING max(abs(difference)) > 0)),
bl AS (SELECT sleep_stat, count(*) AS n, avg(difference) AS bias, stddev_samp(difference) AS sd FROM di GROUP BY sleep_stat),
fit AS (SELECT sleep_stat, regr_slope(difference, ref) AS b1, regr_intercept(difference, ref) AS b0, corr(difference, ref) AS r, count(*) AS n, regr_sxx(difference, ref) AS sxx, regr_syy(difference, ref) AS syy, avg(ref) AS mx FROM di GROUP BY sleep_stat),
rs AS (SELECT di.*, abs(difference - b0 - b1 * ref) AS e FROM di JOIN fit USING (sleep_stat)),
fit2 AS (SELECT sleep_stat, regr_slope(e, ref) AS b1, regr_intercept(e, ref) AS b0, corr(e, ref) AS r, count(*) AS n, regr_sxx(e, ref) AS sxx, regr_syy(e, ref) AS syy, avg(ref) AS mx FROM rs GROUP BY sleep_stat)
"""
)


def _t975(df: str) -> str:
    """SQL of the Student t quantile at 97.5 %, from that of the normal by its expansion in 1 / df."""
    z = 1.959963984540054
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z} + " + " + ".join(f"{c!r} / pow({df}, {i})" for i, c in enumerate(terms, 1)) + ")"


class _Sql(str):
    """SQL text with arithmetic, so that a formula written for columns can be written for DuckDB."""

    def _of(self, op, other):
        return _Sql(f"({self} {op} {other!r})" if isinstance(other, float) else f"({self} {op} {other})")

    def __add__(self, o):
        return self._of("+", o)

    def __sub__(self, o):
        return self._of("-", o)

    def __mul__(self, o):
        return self._of("*", o)

    def __truediv__(self, o):
        return self._of("/", o)

    def __le__(self, o):
        return self._of("<=", o)

    def __lt__(self, o):
        return self._of("<", o)

    def __ge__(self, o):
        return self._of(">=", o)


_SCORE = dist.normal_quantile(_Sql("((rk - 0.375) / (n + 0.25))"), *[lambda *x, f=f: _Sql(f"{f}({', '.join(map(str, x))})") for f in ("sqrt", "ln", "least")], lambda c, a, b: _Sql(f"(CASE WHEN {c} THEN {a} ELSE {b} END)"))
_poly = lambda cs, x: "(" + " + ".join(f"{c!r} * pow({x}, {len(cs) - 1 - i})" for i, c in enumerate(cs)) + ")"

#: ``am``: the assumptions of each statistic, for 12 sessions and more; the tests as comparisons with quantiles.
_ASSUMED = f""", rk AS (SELECT sleep_stat, difference AS x, row_number() OVER (PARTITION BY sleep_stat ORDER BY difference) AS rk, count(*) OVER (PARTITION BY sleep_stat) AS n FROM di),
sc AS (SELECT *, {_SCORE} AS m FROM rk),
sw AS (SELECT sleep_stat, any_value(n) AS n, sum(m * m) AS mm, sum(m * x) AS mx, max(m) AS m1, max(m) FILTER (WHERE rk = n - 1) AS m2, min(x) AS x1, max(x) FILTER (WHERE rk = 2) AS x2, max(x) FILTER (WHERE rk = n - 1) AS y2, max(x) AS y1, var_samp(x) * (any_value(n) - 1) AS ss FROM sc GROUP BY sleep_stat),
sx AS (SELECT *, {_poly([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157], '(1 / sqrt(n))')} * 1 / sqrt(n) + m1 / sqrt(mm) AS a1, {_poly([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981], '(1 / sqrt(n))')} * 1 / sqrt(n) + m2 / sqrt(mm) AS a2 FROM sw),
sy AS (SELECT *, pow(a1 * (y1 - x1) + a2 * (y2 - x2) + (mx - m1 * (y1 - x1) - m2 * (y2 - x2)) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss AS w FROM sx),
sz AS (SELECT *, (ln(1 - w) - {_poly([0.0038915, -0.083751, -0.31082, -1.5861], 'ln(n)')}) / exp({_poly([0.0030302, -0.082676, -0.4803], 'ln(n)')}) AS z FROM sy),
am AS (SELECT sleep_stat, abs(bias) / (sd / sqrt(bl.n)) <= {_t975('(bl.n - 1)')} AS unbiased, z <= 1.6448536269514722 AS normal,
 abs(f.b1) / sqrt((1 - f.r * f.r) * f.syy / f.sxx / (f.n - 2)) <= {_t975('(f.n - 2)')} AS constant_bias, abs(g.b1) / sqrt((1 - g.r * g.r) * g.syy / g.sxx / (g.n - 2)) <= {_t975('(g.n - 2)')} AS homoscedastic
 FROM bl JOIN sz USING (sleep_stat) JOIN fit f USING (sleep_stat) JOIN fit2 g USING (sleep_stat)),
me AS (SELECT sleep_stat, CASE WHEN constant_bias THEN 'param' ELSE 'regr' END AS bias, CASE WHEN homoscedastic THEN 'param' ELSE 'regr' END AS loa, CASE WHEN normal THEN 'param' ELSE 'boot' END AS ci FROM am)
"""


@query(_DIFF + "SELECT sleep_stat, session_id, ref, obs, round(difference, 6) AS difference FROM di")
def ssa_differences(spark, folder):
    return differences(spark, folder).withColumn("difference", F.round("difference", 6))


_DIFF_EVERY = (
    _STATS
    + f""", fst AS (SELECT session_id, min(scorer) AS a FROM five GROUP BY session_id), ro AS (SELECT session_id, scorer, {', '.join(f'round_even({c}::DOUBLE, 4) AS {c}' for c in STATS)} FROM st),
lg AS (UNPIVOT ro ON {', '.join(STATS)} INTO NAME sleep_stat VALUE value),
df AS (SELECT x.sleep_stat, x.session_id, y.scorer AS observer, x.value AS ref, y.value AS obs, y.value - x.value AS difference FROM fst f JOIN lg x ON x.session_id = f.session_id AND x.scorer = f.a JOIN lg y ON y.session_id = f.session_id AND y.scorer <> f.a AND y.sleep_stat = x.sleep_stat WHERE x.value IS NOT NULL AND y.value IS NOT NULL),
di AS (SELECT * FROM df WHERE sleep_stat IN (SELECT sleep_stat FROM df GROUP BY sleep_stat HAVING max(abs(difference)) > 0))
"""
)


def differences_every(spark: SparkSession, folder: str) -> DataFrame:
    """Differences of every other scorer of a session from its first one; the session's key is the pair."""
    stats = cut(H.sleep_statistics(base.five_stage(spark, folder), KEYS))
    first = stats.groupBy("session_id").agg(F.min("scorer").alias("a"))
    rows = stats.join(bounded(first), "session_id")
    ident = F.struct("session_id", F.col("scorer").alias("observer")).alias("pair")
    obs = rows.where("scorer <> a").select(ident, *STATS)
    ref = rows.where("scorer = a").select("session_id", *[F.col(c).alias(f"_{c}") for c in STATS])
    both = rows.where("scorer <> a").select("session_id", "scorer").join(ref.hint("merge"), "session_id")
    return A.differences(both.select(ident, *[F.col(f"_{c}").alias(c) for c in STATS]), obs, "pair", STATS)


@query(_DIFF_EVERY + "SELECT sleep_stat, session_id, observer, ref, obs, round(difference, 6) AS difference FROM di")
def ssa_differences_observers(spark, folder):
    """Sleep statistics of every other scorer against the session's first."""
    return differences_every(spark, folder).select("sleep_stat", "pair.session_id", "pair.observer", "ref", "obs", F.round("difference", 6).alias("difference"))


@query(_DIFF_EVERY + "SELECT sleep_stat, count(*) AS n, round(avg(difference), 6) AS bias, round(stddev_samp(difference), 6) AS sd, round(avg(difference) - 1.96 * stddev_samp(difference), 6) AS lower, round(avg(difference) + 1.96 * stddev_samp(difference), 6) AS upper FROM di GROUP BY sleep_stat")
def ssa_bias_loa_observers(spark, folder):
    return _r(A.bias_and_limits(differences_every(spark, folder)), ["sleep_stat", "n"], 6)


@query(_DIFF + "SELECT sleep_stat, n, round(bias, 6) AS bias, round(sd, 6) AS sd, round(bias - 1.96 * sd, 6) AS lower, round(bias + 1.96 * sd, 6) AS upper FROM bl")
def ssa_bias_loa(spark, folder):
    return _r(A.bias_and_limits(differences(spark, folder)), ["sleep_stat", "n"], 6)


_CI = ", ".join(f"round({v} {sign} t * {k} * sd / sqrt(n), 6) AS {name}_{end}" for name, v, k in (("bias", "bias", "1"), ("lower", "(bias - 1.96 * sd)", "sqrt(3)"), ("upper", "(bias + 1.96 * sd)", "sqrt(3)")) for end, sign in (("low", "-"), ("high", "+")))


@query(_DIFF + f", tq AS (SELECT {_t975('(count(DISTINCT session_id) - 1)')} AS t FROM di) SELECT sleep_stat, n, round(bias, 6) AS bias, round(sd, 6) AS sd, round(bias - 1.96 * sd, 6) AS lower, round(bias + 1.96 * sd, 6) AS upper, {_CI} FROM bl, tq")
def ssa_bias_ci(spark, folder):
    """Bias and limits with parametric confidence intervals."""
    diff = differences(spark, folder)
    n = diff.select("session_id").distinct().count()
    return _r(A.parametric_intervals(A.bias_and_limits(diff), n), ["sleep_stat", "n"], 6)


_FIT = "SELECT f.sleep_stat, " + ", ".join(f"round({a}.b1, 6) AS {p}_slope, round({a}.b0, 6) AS {p}_intercept, round({a}.r, 6) AS {p}_r, round(sqrt((1 - {a}.r * {a}.r) * {a}.syy / {a}.sxx / nullif({a}.n - 2, 0)), 6) AS {p}_stderr, round(sqrt((1 - {a}.r * {a}.r) * {a}.syy / {a}.sxx / nullif({a}.n - 2, 0)) * sqrt({a}.sxx / {a}.n + {a}.mx * {a}.mx), 4) AS {p}_intercept_stderr, {a}.n AS {p}_n" for a, p in (("f", "bias"), ("g", "loa"))) + " FROM fit f JOIN fit2 g USING (sleep_stat)"


@query(_DIFF + _FIT)
def ssa_regression(spark, folder):
    """Bias and limits as lines over the reference."""
    rows = A.regressions(differences(spark, folder))
    keep = ["sleep_stat", "bias_n", "loa_n"]
    return rows.select(*keep, *[F.round(c, 4 if c.endswith("intercept_stderr") else 6).alias(c) for c in rows.columns if c not in keep])


@query(_DIFF + ", lr AS (SELECT sleep_stat, max((obs < 0 OR ref < 0)::INT) AS neg, stddev_samp(ln(obs + 1e-4) - ln(ref + 1e-4)) AS s FROM di GROUP BY sleep_stat) SELECT sleep_stat, round(s, 6) AS log_sd, round(2 * (exp(1.96 * s) - 1) / (exp(1.96 * s) + 1), 6) AS loa_slope FROM lr WHERE neg = 0")
def ssa_log_loa(spark, folder):
    """Limits proportional to the size, from log ratios."""
    return _r(A.log_limits(differences(spark, folder)).where("log_sd is not null").select("sleep_stat", "log_sd", "loa_slope"), ["sleep_stat"], 6)


@query(_DIFF + "SELECT sleep_stat, session_id, obs AS value, round(coalesce((obs - b0) / nullif(1 + b1, 0), obs), 5) AS calibrated FROM (SELECT lg.sleep_stat, d.session_id, lg.value AS obs FROM duo d JOIN lg ON lg.session_id = d.session_id AND lg.scorer = d.b) LEFT JOIN fit USING (sleep_stat)")
def ssa_calibrate(spark, folder):
    """The last scorer's statistics brought to the first one's scale."""
    ref, obs = stats_pair(spark, folder)
    diff = A.differences(ref, obs, "session_id", STATS)
    limits, fit = A.bias_and_limits(diff), A.regressions(diff)
    rows = A.calibrate(obs, "session_id", STATS, limits, fit, "regr").where("value is not null")
    return rows.select("sleep_stat", "session_id", "value", F.round("calibrated", 5).alias("calibrated"))


@query(_DIFF + _ASSUMED + "SELECT * FROM am")
def ssa_assumptions(spark, folder):
    return A.assumptions(differences(spark, folder))


@query(_DIFF + _ASSUMED + "SELECT * FROM me")
def ssa_auto_methods(spark, folder):
    return A.auto_methods(A.assumptions(differences(spark, folder)))


def ssa_bootstrap(spark, folder):
    return A.bootstrap_intervals(differences(spark, folder))


_LINE = "printf('%.2f', {0}) || ' + ' || printf('%.2f', {1}) || 'x'"
_SPREAD = 1.96 * math.sqrt(math.pi / 2)


@query(
    _DIFF
    + _ASSUMED
    + f"SELECT sleep_stat, CASE WHEN me.bias = 'param' THEN printf('%.2f', bl.bias) ELSE {_LINE.format('f.b0', 'f.b1')} END AS bias_text, CASE WHEN loa = 'param' THEN printf('%.2f', bl.bias - 1.96 * sd) || ', ' || printf('%.2f', bl.bias + 1.96 * sd) ELSE 'Bias +- ' || {_LINE.format(f'{_SPREAD!r} * g.b0', f'{_SPREAD!r} * g.b1')} END AS loa_text FROM bl JOIN fit f USING (sleep_stat) JOIN fit2 g USING (sleep_stat) JOIN me USING (sleep_stat)"
)
def ssa_report(spark, folder):
    diff = differences(spark, folder)
    return A.report(A.bias_and_limits(diff), A.regressions(diff), A.auto_methods(A.assumptions(diff)))


QUERIES["ssa_bootstrap"] = ssa_bootstrap
