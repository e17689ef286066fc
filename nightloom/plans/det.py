"""Named queries of the detectors and spectra, on embeddings laid end to end as signals of ten channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dsp
from ..operators.windows import simpson_weights
from ..tables import table
from . import base, detect, simulate, staging
from .base import KEYS, hypnograms, scored

SF = 100.0
BANDS = [(0.5, 4, "Delta"), (4, 8, "Theta"), (8, 12, "Alpha"), (12, 16, "Sigma"), (16, 30, "Beta")]
QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _long(df: DataFrame, keys: list[str], arrays: list[str], names: list[str], digits: int) -> DataFrame:
    """Rows of parallel arrays, one a place, rounded."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("place", "x"))
    return rows.select(*keys, "place", *[F.round(F.col(f"x.{a}"), digits).alias(n) for a, n in zip(arrays, names)])


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of 64 samples, one channel a label, scaled to tens of microvolts."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, folder, "embeddings").where("label is not null")
    return e.select(F.lit("E1").alias("recording_id"), F.concat(F.lit("CH"), F.col("label").cast("string")).alias("channel"), F.col("label").cast("int").alias("ch_idx"), ((F.row_number().over(w) - 1) * 64).cast("bigint").alias("start_sample"), F.transform("embedding", lambda x: x.cast("double") * 150).alias("values"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """A hypnogram for that recording: the epochs of the first scored one, five seconds each."""
    first = scored(spark, folder).agg(F.min(F.struct(*KEYS)).alias("f"))
    rows = scored(spark, folder).join(F.broadcast(first), (F.col("session_id") == F.col("f.session_id")) & (F.col("scorer") == F.col("f.scorer")))
    return rows.select(F.lit("E1").alias("recording_id"), "epoch", "code")


@query
def det_spindles_staged(spark, folder):
    return detect.spindles(signal(spark, folder), SF, staged(spark, folder), freq_sec=5.0, corr=0.3, rms=0.5, duration=(0.2, 3))


@query
def det_slow_waves_staged(spark, folder):
    return detect.slow_waves(signal(spark, folder), SF, staged(spark, folder), freq_sec=5.0, include=(1, 2, 3), amp_neg=(1, 300), amp_pos=(1, 300), amp_ptp=(2, 600))


@query
def spec_bandpower_stage(spark, folder):
    return _power(detect.bandpower(signal(spark, folder), SF, BANDS, staged(spark, folder), freq_sec=5.0, include=(0, 1, 2, 3, 4)))


@query
def det_spindles(spark, folder):
    return detect.spindles(signal(spark, folder), SF, corr=0.3, rms=0.5, duration=(0.2, 3))


@query
def det_slow_waves(spark, folder):
    return detect.slow_waves(signal(spark, folder), SF, amp_neg=(1, 300), amp_pos=(1, 300), amp_ptp=(2, 600), coupling=True)


@query
def det_rems(spark, folder):
    return detect.rapid_eye_movements(signal(spark, folder), SF, loc="CH0", roc="CH1", amplitude=(2, 300))


@query
def det_artefacts_covar(spark, folder):
    return detect.artefacts_covar(detect.epoch_arrays(signal(spark, folder), SF, 1.0), window=1.0)


@query
def det_artefacts(spark, folder):
    return detect.artefacts(detect.epoch_arrays(signal(spark, folder), SF, 1.0), window=1.0)


@query
def det_heartbeats(spark, folder):
    return detect.heartbeats(signal(spark, folder), SF)


@query
def spec_welch(spark, folder):
    return _long(detect.spectra(signal(spark, folder), SF), ["channel"], ["freqs", "psd"], ["freq", "psd"], 6)


def _power(df: DataFrame) -> DataFrame:
    return df.select("channel", "code", *[F.round(c, 6).alias(c) for c in (*[b[2] for b in BANDS], "TotalAbsPow", "FreqRes")])


@query
def spec_bandpower(spark, folder):
    return _power(detect.bandpower(signal(spark, folder), SF, BANDS))


@query
def spec_irasa(spark, folder):
    return detect.aperiodic(signal(spark, folder), SF)


@query
def spec_stft(spark, folder):
    return _long(detect.spectrogram(signal(spark, folder), SF).withColumn("t", F.round("t", 6)), ["channel", "t"], ["freqs", "power"], ["freq", "power"], 6)


@query
def spec_multitaper(spark, folder):
    return _long(detect.multitaper_spectrogram(signal(spark, folder), SF, window=5.0), ["channel", "t"], ["freqs", "decibel"], ["freq", "decibel"], 5)


@query
def sig_filtered(spark, folder):
    return _long(detect.filtered(signal(spark, folder), SF, 1, 30), ["channel"], ["values"], ["value"], 6)


@query
def sig_resampled(spark, folder):
    return _long(detect.resampled(signal(spark, folder), 1, 2), ["channel"], ["values"], ["value"], 6)


@query
def staging_features(spark, folder):
    return staging.features(signal(spark, folder), SF, {"CH0": "eeg", "CH1": "eog", "CH2": "emg"})


@query
def hyp_simulate(spark, folder):
    return simulate.simulate(spark, 20, 60)


@query
def hyp_simulate_similar(spark, folder):
    return simulate.simulate_similar(hypnograms(spark, folder), KEYS, seed=6)


# --- SQL: the transforms written as sums over samples -----------------------------------------------------

_X = """, e AS (SELECT 'CH' || label AS channel, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c, embedding FROM embeddings WHERE label IS NOT NULL),
x AS (SELECT channel, c * 64 + unnest(range(0, 64)) AS s, unnest(embedding)::DOUBLE * 150 AS v FROM e),
n AS (SELECT channel, count(*) AS n FROM x GROUP BY channel)"""


def _values(name: str, numbers) -> str:
    return f", {name}(k, h) AS (VALUES " + ", ".join(f"({k}, {float(h)!r})" for k, h in enumerate(numbers)) + ")"


def _welch_sql(samples: str) -> str:
    """``ps(channel, code, place, psd)`` of ``y(channel, code, s, v)``: Hamming windows of 400 samples half overlapping, the median over them."""
    return f"""{samples}, yn AS (SELECT channel, code, count(*) AS n FROM y GROUP BY ALL),
sg AS (SELECT channel, code, g, s - g * 200 AS j, v - avg(v) OVER (PARTITION BY channel, code, g) AS v FROM (SELECT y.*, n, unnest([s // 200 - 1, s // 200]) AS g FROM y JOIN yn ON y.channel = yn.channel AND y.code IS NOT DISTINCT FROM yn.code) WHERE g >= 0 AND g * 200 + 400 <= n),
ft AS (SELECT channel, code, g, f, sum(v * w * cos(2 * pi() * ((f * j) % 400) / 400)) AS re, sum(v * w * sin(2 * pi() * ((f * j) % 400) / 400)) AS im FROM (SELECT *, 0.54 - 0.46 * cos(2 * pi() * j / 400) AS w FROM sg), range(0, 201) AS t(f) GROUP BY ALL),
sw AS (SELECT sum(pow(0.54 - 0.46 * cos(2 * pi() * j / 400), 2)) AS ww FROM range(0, 400) AS t(j)),
md AS (SELECT channel, code, f, median((re * re + im * im) * CASE WHEN f IN (0, 200) THEN 1 ELSE 2 END / (100 * ww)) AS m, count(*) AS n FROM ft, sw GROUP BY channel, code, f),
ps AS (SELECT channel, code, f AS place, m / (1 + coalesce(list_sum(list_transform(range(1, (n - 1) // 2 + 1), lambda k: 1.0 / (2 * k + 1) - 1.0 / (2 * k))), 0)) AS psd FROM md)"""


_PLAIN = _X + ", y AS (SELECT channel, NULL::INT AS code, s, v FROM x)"
_STAGED = _X + """, st AS (SELECT epoch, code FROM one WHERE (session_id, scorer) IN (SELECT (min((session_id, scorer))) FROM one)),
y AS (SELECT channel, coalesce(code, -2) AS code, row_number() OVER (PARTITION BY channel, coalesce(code, -2) ORDER BY s) - 1 AS s, v FROM x LEFT JOIN st ON st.epoch = s // 500)"""


def _bands_sql(samples: str, where: str) -> str:
    grid = [0.25 * i for i in range(201)]

    def power(a: float, b: float) -> str:
        inside = [i for i, f in enumerate(grid) if a <= f <= b]
        return "(" + " + ".join(f"{w!r} * a[{i + 1}]" for i, w in zip(inside, simpson_weights(len(inside), 0.25))) + ")"

    whole = power(0.5, 30)
    bands = ", ".join(f'round({power(a, b)} / {whole}, 6) AS "{name}"' for a, b, name in BANDS)
    return f"""{_welch_sql(samples)}, ar AS (SELECT channel, code, list(psd ORDER BY place) AS a FROM ps GROUP BY ALL) SELECT channel, code, {bands}, round({whole}, 6) AS "TotalAbsPow", 0.25::DOUBLE AS "FreqRes" FROM ar {where}"""


def _stft_sql() -> str:
    return f"""{_X}, fr AS (SELECT channel, k, k * 20 - 100 AS a FROM n, unnest(range(0, (n + 19) // 20 + 1)) AS t(k)),
sg AS (SELECT fr.channel, k, s - a AS j, v * (0.5 - 0.5 * cos(2 * pi() * (s - a) / 200)) / 100 AS v FROM fr JOIN x ON x.channel = fr.channel AND s >= a AND s < a + 200)
SELECT channel, round(k * 0.2, 6) AS t, (f - 2)::INT AS place, f * 0.5 AS freq, round(pow(sum(v * cos(2 * pi() * ((f * j) % 200) / 200)), 2) + pow(sum(v * sin(2 * pi() * ((f * j) % 200) / 200)), 2), 6) AS power FROM sg, range(2, 61) AS t(f) GROUP BY channel, k, f"""


def _multitaper_sql() -> str:
    tapers = ", ".join(f"({t}, {[float(x) for x in h]!r}::DOUBLE[])" for t, h in enumerate(dsp.slepian(500, 4.0, 7)))
    return f"""{_X}, tp(k, a) AS (VALUES {tapers}), w AS (SELECT x.channel, s // 500 AS g, s % 500 AS j, v - avg(v) OVER (PARTITION BY x.channel, s // 500) AS v FROM x JOIN n ON n.channel = x.channel WHERE (s // 500 + 1) * 500 <= n),
ft AS (SELECT channel, g, k, f, sum(v * a[j + 1] * cos(2 * pi() * ((f * j) % 500) / 500)) AS re, sum(v * a[j + 1] * sin(2 * pi() * ((f * j) % 500) / 500)) AS im FROM w, tp, range(3, 126) AS t(f) GROUP BY ALL)
SELECT channel, (g + 0.5) * 5 AS t, (f - 3)::INT AS place, f * 0.2 AS freq, round(10 * log10(avg(re * re + im * im) / 100 * 2), 5) AS decibel FROM ft GROUP BY channel, g, f"""


SQL |= {
    name: base.SQL + text
    for name, text in {
        "spec_welch": _welch_sql(_PLAIN) + " SELECT channel, place::INT AS place, place * 0.25 AS freq, round(psd, 6) AS psd FROM ps",
        "spec_bandpower": _bands_sql(_PLAIN, ""),
        "spec_bandpower_stage": _bands_sql(_STAGED, "WHERE code BETWEEN 0 AND 4"),
        "sig_filtered": _X
        + _values("tp", dsp.bandpass_taps(SF, 1, 30))
        + """, ed AS (SELECT n.channel, n, max(v) FILTER (WHERE s = 0) AS first, max(v) FILTER (WHERE s = n - 1) AS last FROM x JOIN n ON n.channel = x.channel GROUP BY ALL),
mi AS (SELECT channel, s, v FROM x UNION ALL SELECT x.channel, -s, 2 * first - v FROM x JOIN ed ON ed.channel = x.channel WHERE s > 0 UNION ALL SELECT x.channel, 2 * (n - 1) - s, 2 * last - v FROM x JOIN ed ON ed.channel = x.channel WHERE s < n - 1)
SELECT n.channel, (i)::INT AS place, round(sum(h * v), 6) AS value FROM (SELECT mi.channel, mi.v, tp.h, mi.s + tp.k - (SELECT max(k) // 2 FROM tp) AS i FROM mi, tp) q JOIN n ON n.channel = q.channel WHERE i >= 0 AND i < n GROUP BY n.channel, i""",
        "sig_resampled": _X
        + _values("tp", dsp.resample_taps(1, 2))
        + " SELECT n.channel, i::INT AS place, round(sum(h * v), 6) AS value FROM (SELECT x.channel, x.v, tp.h, (x.s + tp.k - 20) // 2 AS i, (x.s + tp.k - 20) % 2 AS odd FROM x, tp) q JOIN n ON n.channel = q.channel WHERE odd = 0 AND i >= 0 AND i < (n + 1) // 2 GROUP BY n.channel, i",
        "spec_stft": _stft_sql(),
        "spec_multitaper": _multitaper_sql(),
    }.items()
}
