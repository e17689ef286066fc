"""Simulated hypnograms: Markov chains, one session a group, from NumPy's seeded generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hypnogram import transitions

# Transition counts between WAKE, N1, N2, N3 and REM in half-minute epochs.
COUNTS = (
    (11737, 571, 84, 2, 2),
    (281, 6697, 1661, 11, 59),
    (253, 1070, 26259, 505, 272),
    (49, 176, 279, 9630, 12),
    (57, 189, 84, 2, 10071),
)


def chain(p: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``n`` states; each is one multinomial draw from the row of the last."""
    rng = np.random.default_rng(seed)
    states, row = np.zeros(n, np.int32), start
    for k in range(n):
        states[k] = rng.multinomial(1, row).argmax()
        row = p[states[k]]
    return states


def simulate(spark: SparkSession, sessions: int, minutes: float = 300, first_seed: int = 0, freq_sec: float = 30.0) -> DataFrame:
    """``(session_id, epoch, code)`` of so many five-stage nights with seeds from ``first_seed`` on."""
    counts = np.array(COUNTS, float)
    p = counts / counts.sum(1, keepdims=True)
    n = int(minutes * 60 // freq_sec)

    def work(batches):
        for pdf in batches:
            for seed in pdf["id"]:
                yield pd.DataFrame({"session_id": f"SIM{seed:08d}", "epoch": np.arange(n, dtype=np.int32), "code": chain(p, p[0], n, int(seed))})

    return spark.range(first_seed, first_seed + sessions).mapInPandas(work, "session_id string, epoch int, code int")


def simulate_similar(hyp: DataFrame, keys: list[str], seed: int = 0, epochs: int | None = None) -> DataFrame:
    """A new hypnogram for each one, from its own transitions and, unless told, of its length.

    Stages that are never left stay put; a sequence without wake starts from
    the row of its smallest code.
    """
    t = transitions(hyp.where("code >= 0"), keys).select(*keys, "from", "to", "p")
    n = hyp.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    types = dict(hyp.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", epoch int, code int"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = sorted({*pdf["from"], *pdf["to"]})
        p = np.eye(len(codes))
        for code, rows in pdf.groupby("from"):
            p[codes.index(code)] = 0
            for to, share in zip(rows["to"], rows["p"]):
                p[codes.index(code), codes.index(to)] = share
        p /= p.sum(1, keepdims=True)
        m = int(epochs or pdf["_n"].iloc[0])
        states = chain(p, p[0], m, seed)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "epoch": np.arange(m, dtype=np.int32), "code": np.array(codes, np.int32)[states]})

    # a group is at most the square of the number of stages
    return t.join(n, keys).groupBy(*keys).applyInPandas(work, schema)
