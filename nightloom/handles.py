"""Handles that hold lazy DataFrames and offer the operators as methods.

Nothing is read or computed until a result is. Every method returns a handle or
a DataFrame; sequences and recordings are never collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import agreement as A
from .operators import analysis
from .operators import events as E
from .operators import hypnogram as H
from .plans import simulate
from .stages import LABELS, code_of, label_of, spellings, tidy

# Seconds of the units of a length.
_UNITS = {"ms": 0.001, "s": 1.0, "sec": 1.0, "second": 1.0, "min": 60.0, "t": 60.0, "minute": 60.0, "h": 3600.0, "hour": 3600.0}


def seconds(length: str | float) -> float:
    """Seconds of ``30``, ``"30s"``, ``"5min"``, ``"1 hour"``."""
    if isinstance(length, (int, float)):
        return float(length)
    m = re.fullmatch(r"\s*([\d.]+)\s*([A-Za-z]+)\s*", length)
    unit = m and next((u for u in (m[2].lower(), m[2].lower().removesuffix("s")) if u in _UNITS), None)
    if not unit:
        raise ValueError(f"not a length of time: {length}")
    return float(m[1]) * _UNITS[unit]


@dataclass(frozen=True)
class Hypnograms:
    """Stage sequences ``(keys, epoch, code)`` of one epoch length and vocabulary."""

    df: DataFrame
    keys: tuple[str, ...] = ("session_id", "scorer")
    freq_sec: float = 30.0
    n_stages: int = 5

    @classmethod
    def from_spellings(cls, df: DataFrame, stage: str = "stage", keys: Sequence[str] = ("session_id", "scorer"), freq: str | float = 30.0, n_stages: int = 5) -> Hypnograms:
        """From ``(keys, epoch, stage)``; a spelling outside the vocabulary fails the query when it runs."""
        code = code_of(F.col(stage))
        word = tidy(F.col(stage))
        wrong = word.isNotNull() & ~word.isin(spellings(n_stages))
        checked = F.when(wrong, F.raise_error(F.concat(F.lit("no stage of this vocabulary: "), F.col(stage))).cast("int")).otherwise(code)
        rows = df.select(*keys, "epoch", checked.alias("code"))
        return cls(H.dense(rows, list(keys)), tuple(keys), seconds(freq), n_stages)

    @classmethod
    def from_integers(cls, df: DataFrame, value: str, mapping: dict[int, str], keys: Sequence[str] = ("session_id", "scorer"), freq: str | float = 30.0, n_stages: int = 5) -> Hypnograms:
        """From ``(keys, epoch, value)`` through ``mapping``; an unmapped integer fails the query."""
        return cls(df.select(*keys, "epoch", H.checked_codes(F.col(value), mapping, n_stages).alias("code")), tuple(keys), seconds(freq), n_stages)

    def _with(self, df: DataFrame, **more) -> Hypnograms:
        return replace(self, df=df, **more)

    def _timed(self) -> DataFrame:
        return self.df.withColumn("freq_sec", F.lit(self.freq_sec))

    @property
    def sampling_frequency(self) -> float:
        return 1 / self.freq_sec

    def labels(self) -> DataFrame:
        return self.df.withColumn("stage", label_of(F.col("code"), self.n_stages))

    def as_int(self, mapping: dict[int, int] | None = None) -> DataFrame:
        return self.df.withColumn("code", F.col("code").cast("short")) if mapping is None else analysis.remapped(self.df, mapping)

    def as_events(self) -> DataFrame:
        return H.events(self.df, F.lit(self.freq_sec), label_of(F.col("code"), self.n_stages))

    def mask(self, stages: Sequence[str]) -> DataFrame:
        known = LABELS[self.n_stages]
        if unknown := [s for s in stages if s.upper() not in known]:
            raise ValueError(f"no stages of this vocabulary: {unknown}")
        return self.df.withColumn("mask", F.col("code").isin([known[s.upper()] for s in stages]))

    def length(self) -> DataFrame:
        """``(keys, n_epochs, duration)`` in minutes."""
        return self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_epochs"), (F.count(F.lit(1)) * self.freq_sec / 60).alias("duration"))

    def crop(self, start: int, end: int) -> Hypnograms:
        return self._with(H.crop(self.df, start, end))

    def crop_time(self, starts: DataFrame, begin_us: int, end_us: int) -> Hypnograms:
        """Epochs that begin from ``begin_us`` to ``end_us``, both included; starts: ``(keys, start_us)``."""
        step = int(self.freq_sec * 1_000_000)
        at = F.col("start_us") + F.col("epoch") * step
        rows = self.df.join(starts.select(*self.keys, "start_us"), list(self.keys)).where((at >= begin_us) & (at <= end_us))
        first = F.greatest(F.lit(0), F.ceil((F.lit(begin_us) - F.col("start_us")) / step)).cast("int")
        return self._with(rows.withColumn("epoch", F.col("epoch") - first).drop("start_us"))

    def __getitem__(self, at: int | slice) -> Hypnograms:
        """One epoch or a half-open slice, negative numbers from the end; a step is an error."""
        if isinstance(at, slice):
            if at.step not in (None, 1):
                raise ValueError("no step")
            return self._with(H.part(self.df, self.keys, at.start, at.stop))
        return self._with(H.part(self.df, self.keys, at, at + 1 if at != -1 else None))

    def pad(self, before: int, after: int, fill: str = "UNS") -> Hypnograms:
        return self._with(H.pad(self.df, self.keys, before, after, "edge" if fill == "edge" else LABELS[self.n_stages][fill.upper()]))

    def pad_time(self, starts: DataFrame, begin_us: int, fill: str = "UNS") -> Hypnograms:
        """Padded in front to the whole epochs that fit after ``begin_us``."""
        step = int(self.freq_sec * 1_000_000)
        more = starts.select(*self.keys, F.greatest(F.lit(0), F.floor((F.col("start_us") - begin_us) / step)).cast("int").alias("_k"))
        shifted = self.df.join(more, list(self.keys)).select(*self.keys, (F.col("epoch") + F.col("_k")).alias("epoch"), "code")
        front = more.where("_k > 0").join(self.df.select(*self.keys).distinct(), list(self.keys))
        front = front.select(*self.keys, F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("epoch"), F.lit(LABELS[self.n_stages][fill.upper()]).alias("code"))
        return self._with(front.unionByName(shifted))

    def upsample(self, freq: str | float) -> Hypnograms:
        new = seconds(freq)
        factor = self.freq_sec / new
        if factor < 1 or abs(factor - round(factor)) > 1e-9:
            raise ValueError("the new epoch must be a whole part of the old one")
        return self._with(H.upsample(self.df, round(factor)), freq_sec=new)

    def consolidate(self, n_stages: int) -> Hypnograms:
        if self.n_stages != 5 or n_stages not in H.MERGED:
            raise ValueError("five stages can become four, three or two")
        return self._with(H.consolidate(self.df, n_stages), n_stages=n_stages)

    def periods(self, threshold: str | float = 0, equal_length: bool = False) -> DataFrame:
        n = seconds(threshold) / self.freq_sec
        if abs(n - round(n)) > 1e-9:
            raise ValueError("the threshold must be a whole number of epochs")
        if equal_length and n < 1:
            raise ValueError("pieces of equal length need a threshold")
        return H.runs(self.df, self.keys, max(1, round(n)), equal_length)

    def transitions(self) -> DataFrame:
        return H.transitions(self.df, self.keys)

    def stability(self) -> DataFrame:
        return H.stability(self.df, self.keys)

    def statistics(self) -> DataFrame:
        return H.sleep_statistics(self._timed(), self.keys)

    def stage_minutes(self) -> DataFrame:
        return H.stage_minutes(self._timed(), self.keys)

    def at_samples(self, samples: DataFrame, sample: str, sf: float, offset: Column | None = None) -> DataFrame:
        width = self.freq_sec * sf
        if abs(width - round(width)) > 1e-9:
            raise ValueError("an epoch must be a whole number of samples")
        return H.at_samples(samples, self.df, self.keys, sample, round(width), offset)

    def similar(self, seed: int = 0, epochs: int | None = None) -> Hypnograms:
        return self._with(simulate.simulate_similar(self.df, list(self.keys), seed, epochs))

    def change_points(self) -> DataFrame:
        return analysis.change_points(self.df, self.keys)

    def violations(self) -> DataFrame:
        return H.violations(self.df, self.keys, self.n_stages)

    def equals(self, other: Hypnograms) -> DataFrame:
        """``(keys, epoch, equal)`` of the epochs that both have."""
        on = [*self.keys, "epoch"]
        return self.df.join(other.df.withColumnRenamed("code", "_o"), on).select(*on, F.col("code").eqNullSafe(F.col("_o")).alias("equal"))

    def evaluate(self, observed: Hypnograms, session: str = "session_id") -> EpochAgreement:
        return EpochAgreement(self, observed, session)


# Columns that a summary aggregates, by kind of event.
SUMMARY = {
    "spindle": ("Duration", "Amplitude", "RMS", "AbsPower", "RelPower", "Frequency", "Oscillations", "Symmetry"),
    "slow_wave": ("Duration", "ValNegPeak", "ValPosPeak", "PTP", "Slope", "Frequency", "PhaseAtSigmaPeak", "ndPAC"),
    "rem": ("Duration", "LOCAbsValPeak", "ROCAbsValPeak", "LOCAbsRiseSlope", "ROCAbsRiseSlope", "LOCAbsFallSlope", "ROCAbsFallSlope"),
}
_CENTRE = {"spindle": ("Peak", 1.0, 1.0), "slow_wave": ("NegPeak", 0.4, 0.8), "rem": ("Peak", 0.4, 0.4)}


@dataclass(frozen=True)
class Events:
    """Detected events of one kind, with the signal's samples and stage minutes where methods need them."""

    df: DataFrame
    kind: str
    sf: float
    by: tuple[str, ...] = ("recording_id",)
    channel: str = "channel"
    ident: str = "event_id"

    def summary(self, grp_chan: bool = False, grp_stage: bool = False, mask: Column | None = None, aggfunc: str = "mean", minutes: DataFrame | None = None, sort: bool = True) -> DataFrame:
        """Events per recording (and stage, and channel) with aggregates; minutes ``(by, Stage, minutes)`` adds the density."""
        groups = [*self.by, *(["Stage"] if grp_stage else []), *([self.channel] if grp_chan and self.kind != "rem" else [])]
        columns = [c for c in SUMMARY[self.kind] if c in self.df.columns]
        out = E.summary(self.df, groups, columns, aggfunc, ["PhaseAtSigmaPeak"], mask)
        if minutes is not None and grp_stage:
            out = E.density(out, minutes, [*self.by, "Stage"])
        return out.orderBy(*groups) if sort else out

    def _place(self) -> list[str]:
        return [*self.by, self.channel] if self.kind != "rem" else [*self.by]

    def mask(self) -> DataFrame:
        return E.samples_of(self.df, self._place(), F.col("Start"), F.col("End"), self.sf)

    def locked(self, samples: DataFrame, value: str = "value", center: str | None = None, before: float | None = None, after: float | None = None) -> DataFrame:
        c, b, a = _CENTRE[self.kind]
        return E.locked(self.df, samples, self._place(), self.ident, F.col(center or c), self.sf, b if before is None else before, a if after is None else after, value)

    def average(self, samples: DataFrame, value: str = "value", **window) -> DataFrame:
        return E.template(self.locked(samples, value, **window), self._place(), value)

    def coincidence(self, scaled: bool = True) -> DataFrame:
        return E.coincidence(E.spans_of(self.df, self._place(), F.col("Start"), F.col("End"), self.sf), self.by, self.channel, scaled)

    def _tenths(self) -> DataFrame:
        return self.df.withColumn("tenths", E.deciseconds(F.col("Start")))

    def compare_channels(self, max_distance_sec: float = 0.0) -> DataFrame:
        return E.compare_channels(self._tenths(), self.by, self.channel, "tenths", round(max_distance_sec * 10))

    def compare_detection(self, other: Events, max_distance_sec: float = 0.0, other_is_groundtruth: bool = True) -> DataFrame:
        """On the channels that both have."""
        place = self._place()
        common = self.df.select(*place).intersect(other.df.select(*place))
        mine, theirs = (x._tenths().join(common, place, "left_semi") for x in (self, other))
        return E.compare(mine, theirs, place, "tenths", round(max_distance_sec * 10)) if other_is_groundtruth else E.compare(theirs, mine, place, "tenths", round(max_distance_sec * 10))

    def cooccurring(self, spindles: Events, lookaround: float = 1.2) -> DataFrame:
        return E.cooccurring(self.df, spindles.df, self._place(), self.ident, "NegPeak", "Peak", spindles.ident if spindles.ident != self.ident else "Peak", lookaround)

    def on_several_channels(self) -> Events:
        return replace(self, df=E.on_several(self.df, self.by, "Start", F.col("End")))


@dataclass(frozen=True)
class EpochAgreement:
    """A reference and an observed set of hypnograms of the same sessions."""

    ref: Hypnograms
    obs: Hypnograms
    session: str = "session_id"

    def __post_init__(self) -> None:
        if (self.ref.freq_sec, self.ref.n_stages) != (self.obs.freq_sec, self.obs.n_stages):
            raise ValueError("epoch length and vocabulary must be the same")

    def pairs(self) -> DataFrame:
        return A.paired(self.ref.df, self.obs.df, [self.session, "epoch"])

    def unpaired(self) -> DataFrame:
        """Epochs that only one scored; none when the sets fit."""
        on = [self.session, "epoch"]
        a, b = (h.df.select(*on) for h in (self.ref, self.obs))
        return a.exceptAll(b).unionByName(b.exceptAll(a))

    def confusion(self, pooled: bool = False) -> DataFrame:
        return A.full_confusion(self.pairs(), [] if pooled else [self.session], list(LABELS[self.ref.n_stages].values()))

    def agreement(self, pooled: bool = False, scorers: dict[str, Callable] | None = None) -> DataFrame:
        by = [] if pooled else [self.session]
        return A.custom_scores(self.pairs(), [self.session], scorers) if scorers else A.agreement(A.confusion(self.pairs(), by), by)

    def by_stage(self, beta: float = 1.0, pooled: bool = False) -> DataFrame:
        by = [] if pooled else [self.session]
        return A.agreement_by_stage(A.confusion(self.pairs(), by), by, beta)

    def summary(self, by_stage: bool = False) -> DataFrame:
        if by_stage:
            return A.summarise(self.by_stage().drop(self.session, "support"), ("fbeta", "npv", "precision", "recall", "specificity"), ["stage"])
        return A.summarise(self.agreement().drop(self.session))

    def statistics(self) -> tuple[DataFrame, DataFrame]:
        return tuple(h.statistics().drop(*[k for k in h.keys if k != self.session]) for h in (self.ref, self.obs))


@dataclass(frozen=True)
class StatsAgreement:
    """Reference and observed sleep statistics ``(session, statistics...)``."""

    ref: DataFrame
    obs: DataFrame
    stats: tuple[str, ...]
    session: str = "session_id"
    agreement: float = 1.96
    confidence: float = 0.95
    alpha: float = 0.05
    log_transform: bool = False

    def __post_init__(self) -> None:
        for name in ("confidence", "alpha"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")

    def data(self) -> DataFrame:
        return A.differences(self.ref, self.obs, self.session, self.stats)

    def n_sessions(self) -> int:
        return self.data().select(self.session).distinct().count()

    def limits(self) -> DataFrame:
        return A.bias_and_limits(self.data(), self.agreement)

    def regressions(self) -> DataFrame:
        return A.regressions(self.data())

    def assumptions(self) -> DataFrame:
        return A.assumptions(self.data(), self.alpha)

    def methods(self) -> DataFrame:
        return A.auto_methods(self.assumptions(), self.log_transform)

    def summary(self, ci_method: str = "param") -> DataFrame:
        if ci_method == "boot":
            return A.bootstrap_intervals(self.data(), confidence=self.confidence, agreement_factor=self.agreement)
        return A.parametric_intervals(self.limits(), self.n_sessions(), self.confidence)

    def log_limits(self) -> DataFrame:
        return A.log_limits(self.data(), self.agreement, self.confidence)

    def calibrate(self, observed: DataFrame, method: str = "param", adjust_all: bool = False) -> DataFrame:
        return A.calibrate(observed, self.session, self.stats, self.limits(), self.regressions(), method, None if adjust_all else self.assumptions())

    def report(self) -> DataFrame:
        return A.report(self.limits(), self.regressions(), self.methods(), self.agreement)

    def plot_data(self) -> DataFrame:
        return analysis.difference_plot(self.data(), self.limits())
