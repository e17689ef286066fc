"""Named queries of the general data-preparation operators (p1, p2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clock, spikes
from ..tables import latest, table

#: Readings no living heart gives lie outside these (fixed values of the data's description).
PLAUSIBLE = {"hr_mean": (20.0, 250.0), "hrv_rmssd": (1.0, 1000.0)}


def flagged_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading of hrv_stage with its flags; a period delivered again counts once, in its last form."""
    delivered = table(spark, folder, "hrv_stage")
    periods = latest(delivered, ["period_id"], "loaded_at", ["recording_id", "stage", "start", *PLAUSIBLE])
    return spikes.flag(periods, ident="period_id", source="recording_id", time="start", season="stage", fields=PLAUSIBLE, sizing=delivered)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Wrong readings: ``(period_id, field)``."""
    wrong = F.col("implausible") | F.col("stuck") | F.col("extreme")
    return flagged_readings(spark, folder).where(wrong).select(F.col("ident").alias("period_id"), "field")


def instants(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of hypnograms and recordings: ``(rec_id, utc_us)``, null where the text names no single instant.

    A row delivered again counts once, in its last form. A hypnogram's site is
    its recording's; where the recording is missing only the row's own zone is
    left, and a slashed date that doesn't begin with the year names none.
    """
    site = table(spark, folder, "site").groupBy("site_id").agg(F.max("tz").alias("site_tz"), F.max("date_order").alias("date_order"))
    recording = latest(table(spark, folder, "recording"), ["recording_id"], "loaded_at", ["meas_date", "is_local", "tz", "site_id"]).where("recording_id is not null")
    session = latest(table(spark, folder, "sleep_session"), ["hypno_id"], "loaded_at", ["recording_id", "start", "tz"])
    session = session.join(recording.select("recording_id", "site_id"), "recording_id", "left")
    one = recording.select(F.col("recording_id").alias("rec_id"), F.col("meas_date").alias("written"), "is_local", "tz", "site_id")
    two = session.select(F.col("hypno_id").alias("rec_id"), F.col("start").alias("written"), F.lit(False).alias("is_local"), "tz", "site_id")
    rows = one.unionByName(two).join(site, "site_id", "left")
    placed = clock.instants(rows, "written", F.col("tz"), site_zone=F.col("site_tz"), date_order=F.col("date_order"), is_local=F.col("is_local"))
    return placed.select("rec_id", "utc_us")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Starts that name exactly one instant: ``(rec_id, utc_us)``."""
    return instants(spark, folder).where("utc_us is not null")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found}



def _instants_sql() -> str:
    """``at(rec_id, utc_us)``: the cascade of patterns, and a local reading placed by the offsets a day before and after."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(t, {quoted(p)}) THEN '{name}|' || regexp_replace(t, {quoted(p)}, '{'|'.join(chr(92) + str(g) if g < 10 and g else '' for g in groups)}')" for name, p, groups in clock.PATTERNS)
    zones = ", ".join(f"('{z}', '{a}', {offsets})" for z, a, offsets in clock.abbreviation_rows())
    months = ", ".join(f"('{m}', {i})" for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1))
    offset = lambda u: f"(epoch_us(timezone(z, make_timestamptz(({u})::BIGINT))) - ({u}))"
    return f"""WITH zn AS (SELECT DISTINCT name FROM pg_timezone_names()), ab(z, abbr, offs) AS (VALUES {zones}), mn(m, i) AS (VALUES {months}),
st AS (SELECT site_id, max(tz) AS site_tz, max(date_order) AS o FROM site GROUP BY site_id),
rc AS (SELECT * FROM recording WHERE recording_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY loaded_at DESC NULLS LAST, meas_date DESC NULLS LAST, is_local DESC NULLS LAST, tz DESC NULLS LAST, site_id DESC NULLS LAST) = 1),
ss AS (SELECT * FROM sleep_session QUALIFY row_number() OVER (PARTITION BY hypno_id ORDER BY loaded_at DESC NULLS LAST, recording_id DESC NULLS LAST, start DESC NULLS LAST, tz DESC NULLS LAST) = 1),
rw AS (SELECT recording_id AS rec_id, meas_date AS w, coalesce(is_local, false) AS loc, tz, site_id FROM rc UNION ALL SELECT hypno_id, start, false, ss.tz, rc.site_id FROM ss LEFT JOIN rc USING (recording_id)),
tx AS (SELECT rec_id, loc, upper(trim(o)) AS o, regexp_replace(w, '^[\\s\\p{{Z}}\\p{{Cc}}]+|[\\s\\p{{Z}}\\p{{Cc}}]+$', '', 'g') AS t, (SELECT name FROM zn WHERE name = trim(tz)) AS z1, (SELECT name FROM zn WHERE name = trim(site_tz)) AS z2 FROM rw LEFT JOIN st USING (site_id)),
pt AS (SELECT *, string_split(CASE {cases} END, '|') AS f FROM tx),
fd AS (SELECT *, f[1] AS kind, try_cast(f[2] AS INT) + CASE WHEN f[1] = 'dotted' THEN 2000 ELSE 0 END AS y, coalesce((SELECT i FROM mn WHERE m = upper(f[3])), try_cast(f[3] AS INT)) AS a, try_cast(f[4] AS INT) AS b, try_cast(f[5] AS INT) AS h0, try_cast(f[6] AS INT) AS mi, coalesce(try_cast(f[7] AS INT), 0) AS s, coalesce(try_cast(rpad(left(f[8], 6), 6, '0') AS INT), 0) AS us, upper(nullif(f[9], '')) AS ap, nullif(f[10], '') AS zone, (SELECT name FROM zn WHERE name = trim(f[11])) AS zb, nullif(f[12], '') AS dow,
 CASE WHEN regexp_matches(t, '^\\d{{9,16}}$') THEN CASE WHEN length(t) <= 10 THEN t::BIGINT * 1000000 WHEN length(t) IN (12, 13) THEN t::BIGINT * 1000 WHEN length(t) >= 15 THEN t::BIGINT END END AS ep FROM pt),
dt AS (SELECT *, CASE WHEN kind LIKE 'slashed%' THEN CASE o WHEN 'DMY' THEN b WHEN 'MDY' THEN a END ELSE a END AS mo, CASE WHEN kind LIKE 'slashed%' THEN CASE o WHEN 'DMY' THEN a WHEN 'MDY' THEN b END ELSE b END AS d, CASE WHEN ap IS NULL THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN ap = 'PM' THEN 12 ELSE 0 END END AS h FROM fd),
wl AS (SELECT *, try_cast(printf('%04d-%02d-%02d', y, mo, d) AS DATE) AS dd FROM dt),
wm AS (SELECT *, CASE WHEN y BETWEEN 1900 AND 2199 AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 AND (dow IS NULL OR dow = left(dayname(dd), 3)) THEN (((dd - DATE '1970-01-01') * 86400 + h * 3600 + mi * 60 + s) * 1000000 + us)::BIGINT END AS wall, upper(zone) AS mark, coalesce(regexp_extract(zone, '^(?:UTC|GMT|UT)?([+-]\\d{{2}}(?::?\\d{{2}})?)$', 1), '') AS num FROM wl),
wn AS (SELECT *, try_cast(substr(num, 2, 2) AS INT) AS oh, CASE WHEN length(num) > 3 THEN right(num, 2)::INT ELSE 0 END AS om, coalesce(zb, z1, z2) AS z FROM wm),
wo AS (SELECT wn.*, num <> '' AND NOT (oh <= 18 AND om < 60) AS bad, CASE WHEN mark IN ('Z', 'UTC', 'UT') THEN 0 WHEN num <> '' AND oh <= 18 AND om < 60 THEN (oh * 3600 + om * 60) * CASE WHEN num LIKE '-%' THEN -1 ELSE 1 END END AS off, CASE WHEN zone IS NOT NULL AND num = '' AND mark NOT IN ('Z', 'UTC', 'UT') THEN mark END AS nick FROM wn),
wp AS (SELECT wo.* EXCLUDE (off), CASE WHEN nick = 'GMT' AND offs IS NULL AND NOT loc THEN 0 WHEN loc AND off = 0 THEN NULL ELSE off END AS off, offs FROM wo LEFT JOIN ab ON ab.z = wo.z AND ab.abbr = wo.nick),
wq AS (SELECT *, wall - {offset("wall - 86400000000")} AS u1, wall - {offset("wall + 86400000000")} AS u2 FROM wp),
wr AS (SELECT *, CASE WHEN {offset("u1")} = wall - u1 AND (nick IS NULL OR list_contains(offs, ((wall - u1) // 1000000)::INT)) THEN u1 END AS v1, CASE WHEN {offset("u2")} = wall - u2 AND (nick IS NULL OR list_contains(offs, ((wall - u2) // 1000000)::INT)) THEN u2 END AS v2 FROM wq),
at_ AS (SELECT rec_id, CASE WHEN ep IS NOT NULL THEN ep WHEN off IS NOT NULL THEN wall - off::BIGINT * 1000000 WHEN NOT coalesce(bad, false) THEN CASE WHEN v1 IS NULL THEN v2 WHEN v2 IS NULL OR v1 = v2 THEN v1 END END AS utc_us FROM wr)
"""


#: Common table expressions that end in at_(rec_id, utc_us), null where a text names no single instant.
INSTANTS_SQL = _instants_sql()

#: The definition of a wrong reading itself, with the scale's cut between six and eight.
SQL = {
    "p2_found": INSTANTS_SQL + "SELECT rec_id, utc_us FROM at_ WHERE utc_us IS NOT NULL",
    "p1_found": """WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_id ORDER BY loaded_at DESC) AS rn FROM hrv_stage) WHERE rn = 1),
l AS (SELECT period_id, recording_id, start, 'hr_mean' AS field, hr_mean AS v, hr_mean < 20 OR hr_mean > 250 AS bad FROM h UNION ALL SELECT period_id, recording_id, start, 'hrv_rmssd', hrv_rmssd, hrv_rmssd < 1 OR hrv_rmssd > 1000 FROM h),
n AS (SELECT *, v IS DISTINCT FROM lag(v) OVER w AS new FROM l WHERE v IS NOT NULL WINDOW w AS (PARTITION BY recording_id, field ORDER BY start, period_id)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY recording_id, field ORDER BY start, period_id) AS r FROM n),
s AS (SELECT *, count(*) OVER (PARTITION BY recording_id, field, r) >= 5 AS stuck FROM g),
m AS (SELECT recording_id, field, quantile_disc(v, 0.5) AS mid FROM s WHERE NOT bad AND NOT stuck GROUP BY ALL),
d AS (SELECT recording_id, field, 1.4826 * quantile_disc(abs(v - mid), 0.5) AS scale FROM s JOIN m USING (recording_id, field) WHERE NOT bad AND NOT stuck GROUP BY ALL)
SELECT period_id, field FROM s LEFT JOIN m USING (recording_id, field) LEFT JOIN d USING (recording_id, field) WHERE bad OR stuck OR (abs(v - mid) > 7 * scale AND scale > 0)""",
}
