"""Epoch features of a night and a classifier trained on them.

Features follow the published set: descriptive statistics, spectral power and
ratios, entropies of every half minute of up to three channels, each plain,
smoothed over 7 minutes and over the past 2 minutes (the latter two scaled
robustly within the night), with time and personal data. No trained model comes
with the library; :func:`train` fits one.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp, entropy
from ..operators.windows import simpson_weights
from .detect import joined

# Bands of the staging features.
BANDS = ((0.4, 1, "sdelta"), (1, 4, "fdelta"), (4, 8, "theta"), (8, 12, "alpha"), (12, 16, "sigma"), (16, 30, "beta"))
BROAD = (0.4, 30.0)
_BASE = ["std", "iqr", "skew", "kurt", "nzc", "hmob", "hcomp", "abspow", "perm", "higuchi", "petrosian"]
_POWER = [b for _, _, b in BANDS]
_RATIO = ["dt", "ds", "db", "at"]
FEATURES = {"eeg": _BASE + _POWER + _RATIO, "eog": _BASE + _POWER, "emg": _BASE}
_SUFFIX = ("", "_c7min_norm", "_p2min_norm")


def feature_names(kinds: tuple[str, ...] = ("eeg", "eog", "emg"), personal: tuple[str, ...] = ()) -> list[str]:
    """Sorted names of the features of these channels."""
    return sorted([f"{k}_{f}{s}" for k in kinds for f in FEATURES[k] for s in _SUFFIX] + ["time_hour", "time_norm", *personal])


def epoch_features(x: np.ndarray, sf: float, kind: str) -> dict[str, np.ndarray]:
    """Plain features of each whole half minute of one channel."""
    width = int(30 * sf)
    n = len(x) // width
    parts = dsp.bandpass(x, sf, *BROAD)[: n * width].reshape(n, width)
    c = parts - parts.mean(1, keepdims=True)
    m2, m3, m4 = ((c**k).mean(1) for k in (2, 3, 4))
    mobility, complexity = entropy.hjorth(parts)
    low, high = np.quantile(parts, [0.25, 0.75], axis=1)
    f, psd = dsp.welch(parts, sf, int(5 * sf))
    dx = f[1] - f[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = {"std": parts.std(1, ddof=1), "iqr": high - low, "skew": m3 / m2**1.5, "kurt": m4 / m2**2 - 3, "nzc": (np.diff(np.signbit(parts).astype(np.int8)) != 0).sum(1).astype(float), "hmob": mobility, "hcomp": complexity}

        def power(a: float, b: float) -> np.ndarray:
            inside = (f >= a - 1e-9) & (f <= b + 1e-9)
            return psd[:, inside] @ np.array(simpson_weights(int(inside.sum()), dx))

        if kind != "emg":
            whole = power(BANDS[0][0], BANDS[-1][1])
            out |= {name: power(a, b) / whole for a, b, name in BANDS}
        if kind == "eeg":
            delta = out["sdelta"] + out["fdelta"]
            out |= {"dt": delta / out["theta"], "ds": delta / out["sigma"], "db": delta / out["beta"], "at": out["alpha"] / out["theta"]}
    broad = psd[:, (f >= BROAD[0] - 1e-9) & (f <= BROAD[1] + 1e-9)]
    out["abspow"] = ((broad[:, 1:] + broad[:, :-1]) / 2).sum(1) * dx
    return out | {"perm": entropy.permutation_entropy(parts), "higuchi": entropy.higuchi(parts), "petrosian": entropy.petrosian(parts)}


def smoothed(v: np.ndarray, weights: np.ndarray, centred: bool) -> np.ndarray:
    """Weighted mean over neighbouring rows that exist (centred or trailing)."""
    total, share = np.convolve(v, weights[::-1] if not centred else weights), np.convolve(np.ones(len(v)), weights[::-1] if not centred else weights)
    shift = len(weights) // 2 if centred else 0
    return total[shift : shift + len(v)] / share[shift : shift + len(v)]


def robust(v: np.ndarray) -> np.ndarray:
    low, mid, high = np.nanquantile(v, [0.05, 0.5, 0.95])
    return (v - mid) / (high - low if high > low else 1.0)


_TRIANGLE = np.concatenate([np.arange(1, 9), np.arange(7, 0, -1)]) / 8


def features(signal: DataFrame, sf: float, kinds: Mapping[str, str], personal: DataFrame | None = None) -> DataFrame:
    """``(recording_id, epoch, features...)`` as floats, columns sorted.

    kinds: channel name to ``eeg``, ``eog`` or ``emg``; signals are brought to
    100 Hz. personal: ``(recording_id, age, male)``. Recordings shorter than half
    a minute have no rows; a channel missing in a recording leaves nulls.
    """
    names = sorted({f"{f}{s}" for k in set(kinds.values()) for f in FEATURES[k] for s in _SUFFIX})
    schema = "recording_id string, kind string, epoch int, n int, " + ", ".join(f"{n} double" for n in names)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = kinds[pdf["channel"].iloc[0]]
        x = joined(pdf)
        if sf != 100:
            x = dsp.resample(x, 100, int(sf))
        if len(x) < 3000:
            return pd.DataFrame(columns=["recording_id", "kind", "epoch", "n", *names])
        found = epoch_features(x, 100.0, kind)
        n = len(found["std"])
        cols = {"recording_id": pdf["recording_id"].iloc[0], "kind": kind, "epoch": np.arange(n, dtype=np.int32), "n": n}
        for f, v in found.items():
            cols[f] = v
            cols[f"{f}_c7min_norm"] = robust(smoothed(v, _TRIANGLE, True))
            cols[f"{f}_p2min_norm"] = robust(smoothed(v, np.ones(4), False))
        return pd.DataFrame(cols).reindex(columns=["recording_id", "kind", "epoch", "n", *names])

    long = signal.where(F.col("channel").isin(*kinds)).groupBy("recording_id", "channel", "ch_idx").applyInPandas(work, schema)
    picked = [F.max(F.when(F.col("kind") == k, F.col(f"{f}{s}"))).cast("float").alias(f"{k}_{f}{s}") for k in sorted(set(kinds.values())) for f in FEATURES[k] for s in _SUFFIX]
    wide = long.groupBy("recording_id", "epoch").agg(F.max("n").alias("n"), *picked)
    seconds = F.col("epoch") * 30
    wide = wide.withColumns({"time_hour": (seconds / 3600).cast("float"), "time_norm": F.try_divide(seconds, (F.col("n") - 1) * 30).cast("float")}).drop("n")
    if personal is not None:
        wide = wide.join(personal.select("recording_id", F.col("age").cast("int"), F.col("male").cast("int")), "recording_id", "left")
    return wide.select("recording_id", "epoch", *sorted(c for c in wide.columns if c not in ("recording_id", "epoch")))


def check_features(model_features: list[str], table: DataFrame) -> None:
    """Error if a feature is missing or one too many is there."""
    there = {c for c in table.columns if c not in ("recording_id", "epoch", "code", "label")}
    missing, extra = set(model_features) - there, there - set(model_features)
    if missing or extra:
        raise ValueError(f"missing features {sorted(missing)}, unknown features {sorted(extra)}")


def train(table: DataFrame, label: str = "code", trees: int = 100, depth: int = 12, seed: int = 42):
    """A pipeline model (assembler and random forest) of labelled features; labels are codes of 0 to 4."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    columns = [c for c in table.columns if c not in ("recording_id", "epoch", label)]
    rows = table.where(F.col(label).between(0, 4)).withColumn("label", F.col(label).cast("double"))
    steps = [VectorAssembler(inputCols=columns, outputCol="vector", handleInvalid="keep"), RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=steps).fit(rows.na.fill(0.0, columns))


def predict(model, table: DataFrame) -> DataFrame:
    """``(recording_id, epoch, code, proba map<code, probability>)``."""
    from pyspark.ml.functions import vector_to_array

    columns = model.stages[0].getInputCols()
    check_features(list(columns), table)
    scored = model.transform(table.na.fill(0.0, list(columns)))
    p = vector_to_array("probability")
    return scored.select("recording_id", "epoch", F.col("prediction").cast("int").alias("code"), F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i.cast("string")), p).alias("proba"))


def majority_only(predicted: DataFrame) -> DataFrame:
    """``predicted`` with every probability but the greatest set to null."""
    top = F.array_max(F.map_values("proba"))
    return predicted.withColumn("proba", F.transform_values("proba", lambda k, v: F.when(v == top, v)))
