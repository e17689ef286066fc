"""Views of the input tables that the named queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hypnogram as H
from ..stages import CODES, LABELS, code_of
from ..tables import last_code, latest, table

KEYS = ["session_id", "scorer"]


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """``(session_id, scorer, hypno_id, recording_id, n_stages, freq_sec, start, tz)``, last delivery."""
    return latest(table(spark, folder, "sleep_session"), KEYS, "loaded_at", ["hypno_id", "recording_id", "n_stages", "freq_sec", "start", "tz"])


def scored(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """``(session_id, scorer, epoch, code)``, last delivery; null code without a known stage.

    Brought together by hypnogram at once: what follows works on whole nights,
    so this is the only shuffle of the epochs. parts: into so many tasks.
    """
    rows = table(spark, folder, "hypnogram").select(*KEYS, "epoch", "loaded_at", code_of(F.col("stage")).alias("code"))
    return last_code(spread(rows, parts), [*KEYS, "epoch"], "loaded_at", F.col("code"), "code")


def hypnograms(spark: SparkSession, folder: str, parts: int | None = None) -> DataFrame:
    """The same without gaps."""
    return H.dense(scored(spark, folder, parts), KEYS)


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """``df`` brought together by hypnogram, in ``parts`` tasks, else in as many as the session's shuffles have."""
    return df.repartition(*([parts] if parts else []), *KEYS)


def parts(spark: SparkSession, folder: str, rows: int = 300_000) -> int | None:
    """Tasks that hold about ``rows`` epochs each, so that none spills; None if the session's own are small enough. Rows are counted from the files' footers now."""
    need = min(table(spark, folder, "hypnogram").count() // rows, 2000)  # beyond, the driver keeps too much about so many
    return need if need > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def five_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Hypnograms of five stages with their epoch length."""
    ses = sessions(spark, folder).where("n_stages = 5").select(*KEYS, "freq_sec")
    return hypnograms(spark, folder).join(ses, KEYS)


_CODES = ", ".join(f"('{k}', {v})" for k, v in CODES.items())
_LABELS = ", ".join(f"({n}, '{k}', {v})" for n, labels in LABELS.items() for k, v in labels.items())

#: Common table expressions: ses, one (scored epochs), hyp (without gaps), five (five-stage ones with freq_sec), lab.
SQL = f"""
WITH codes(sp, code) AS (VALUES {_CODES}), lab(n_stages, label, code) AS (VALUES {_LABELS}),
ses AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY session_id, scorer ORDER BY loaded_at DESC, hypno_id DESC) AS rn FROM sleep_session) WHERE rn = 1),
spelt AS (SELECT h.session_id, h.scorer, h.epoch, h.loaded_at, c.code FROM hypnogram h LEFT JOIN codes c ON c.sp = upper(trim(h.stage, ' ' || chr(9) || chr(10) || chr(13)))),
one AS (SELECT session_id, scorer, epoch, code FROM (SELECT *, row_number() OVER (PARTITION BY session_id, scorer, epoch ORDER BY loaded_at DESC, code DESC NULLS LAST) AS rn FROM spelt) WHERE rn = 1),
span AS (SELECT session_id, scorer, max(epoch) AS last FROM one WHERE epoch >= 0 GROUP BY ALL),
grid AS (SELECT session_id, scorer, unnest(range(0, last + 1))::INT AS epoch FROM span),
hyp AS (SELECT g.session_id, g.scorer, g.epoch, coalesce(o.code, -2)::INT AS code FROM grid g LEFT JOIN one o USING (session_id, scorer, epoch)),
five AS (SELECT hyp.*, ses.freq_sec FROM hyp JOIN ses USING (session_id, scorer) WHERE ses.n_stages = 5)
"""
