"""Stage sequences: validation, encoding, shape changes, runs, transitions, statistics.

A hypnogram is a DataFrame ``(keys..., epoch, code)``: one row per epoch, whole
numbers from 0 without gaps, codes of :mod:`nightloom.stages`. ``keys`` name the
sequence (session and scorer, say); every window and group carries them. The
session dimension ``(keys..., freq_sec, n_stages, start_us)`` is joined where a
length in seconds is needed. Empty tables give empty results; a null code is an
unknown stage that equals no other unless stated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stages import LABELS, label_of

# Target code of each five-stage code after consolidation (2, 3 or 4 stages).
MERGED = {
    4: {0: 0, 1: 2, 2: 2, 3: 3, 4: 4, -1: -1, -2: -2},
    3: {0: 0, 1: 2, 2: 2, 3: 2, 4: 4, -1: -1, -2: -2},
    2: {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, -1: -1, -2: -2},
}


def _along(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("epoch")


def dense(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps closed: every epoch from 0 to the last, missing ones and null codes as unscored (-2).

    ``(keys, epoch)`` must be unique; negative and null epochs are dropped.
    """
    rows = rows.where("epoch >= 0").select(*keys, F.col("epoch").cast("int").alias("epoch"), F.col("code").cast("int").alias("code"))
    w = _along(keys)
    # each row also stands for the gap behind it, the first one for the gap before it
    first = F.when(F.lag("epoch").over(w).isNull(), 0).otherwise(F.col("epoch"))
    last = F.coalesce(F.lead("epoch").over(w) - 1, F.col("epoch"))
    wide = rows.withColumns({"_a": first, "_b": last}).withColumn("_e", F.explode(F.sequence("_a", "_b")))
    return wide.select(*keys, F.col("_e").alias("epoch"), F.when(F.col("_e") == F.col("epoch"), F.coalesce("code", F.lit(-2))).otherwise(-2).alias("code"))


def violations(hyp: DataFrame, keys: Sequence[str], n_stages: int = 5) -> DataFrame:
    """``(keys, n_gaps, n_repeats, n_foreign)`` of the sequences that break an invariant: no gaps, one row an epoch, closed vocabulary."""
    allowed = list(LABELS[n_stages].values())
    g = hyp.groupBy(*keys).agg(
        (F.max("epoch") + 1 - F.countDistinct("epoch")).alias("n_gaps"),
        (F.count("epoch") - F.countDistinct("epoch")).alias("n_repeats"),
        F.count_if(F.col("code").isNull() | ~F.col("code").isin(allowed)).alias("n_foreign"),
    )
    return g.where("n_gaps > 0 or n_repeats > 0 or n_foreign > 0")


def checked_codes(values: Column, mapping: Mapping[int, str], n_stages: int = 5) -> Column:
    """Codes of a foreign integer scoring through ``mapping`` (integer to label); an unmapped integer fails the query."""
    codes = LABELS[n_stages]
    table = F.create_map(*[x for k, label in mapping.items() for x in (F.lit(k), F.lit(codes[label.upper()]))])
    found = F.try_element_at(table, values)
    return F.when(values.isNull(), F.lit(None)).otherwise(F.coalesce(found, F.raise_error(F.concat(F.lit("no stage for "), values.cast("string"))).cast("int")))


def consolidate(hyp: DataFrame, n_stages: int) -> DataFrame:
    """Five stages merged to 4, 3 or 2."""
    table = F.create_map(*[x for k, v in MERGED[n_stages].items() for x in (F.lit(k), F.lit(v))])
    return hyp.withColumn("code", F.try_element_at(table, F.col("code").cast("int")))


def crop(hyp: DataFrame, start: int, end: int) -> DataFrame:
    """Epochs ``start`` to ``end``, both included, numbered from 0 again."""
    if end < start:
        raise ValueError("an empty range")
    return hyp.where(F.col("epoch").between(start, end)).withColumn("epoch", F.col("epoch") - start)


def part(hyp: DataFrame, keys: Sequence[str], start: int | None, stop: int | None) -> DataFrame:
    """Half-open slice; negative bounds count from each sequence's end. Numbered from 0 again."""
    n = F.max("epoch").over(Window.partitionBy(*keys)) + 1
    at = lambda x, default: default if x is None else (n + x if x < 0 else F.lit(x))
    rows = hyp.withColumns({"_a": F.greatest(at(start, F.lit(0)), F.lit(0)), "_b": F.least(at(stop, n), n)})
    return rows.where("epoch >= _a and epoch < _b").withColumn("epoch", F.col("epoch") - F.col("_a")).drop("_a", "_b")


def pad(hyp: DataFrame, keys: Sequence[str], before: int, after: int, fill: int | str = -2) -> DataFrame:
    """``before`` and ``after`` more epochs of code ``fill``, or of the first and last stage (``"edge"``)."""
    ends = hyp.groupBy(*keys).agg(F.min_by("code", "epoch").alias("_f"), F.max_by("code", "epoch").alias("_l"), F.max("epoch").alias("_n"))
    value = (lambda c: F.col(c)) if fill == "edge" else (lambda c: F.lit(fill))
    head = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(before - 1))).alias("epoch"), value("_f").alias("code")) if before > 0 else None
    tail = ends.select(*keys, F.explode(F.sequence(F.col("_n") + before + 1, F.col("_n") + before + after)).alias("epoch"), value("_l").alias("code")) if after > 0 else None
    out = hyp.select(*keys, (F.col("epoch") + before).alias("epoch"), "code")
    for more in (head, tail):
        out = out if more is None else out.unionByName(more)
    return out


def upsample(hyp: DataFrame, factor: int) -> DataFrame:
    """Every epoch as ``factor`` shorter ones."""
    if factor < 1:
        raise ValueError("epochs can only become shorter")
    return hyp.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("epoch", F.col("epoch") * factor + F.col("_k")).drop("_k")


def at_samples(samples: DataFrame, hyp: DataFrame, keys: Sequence[str], sample: str, samples_per_epoch: int | Column, offset: Column | None = None) -> DataFrame:
    """``samples`` plus ``code``: the stage of the epoch a sample falls in, -2 beyond the hypnogram.

    offset: epochs by which the recording starts after the hypnogram.
    """
    width = F.lit(samples_per_epoch) if isinstance(samples_per_epoch, int) else samples_per_epoch
    epoch = F.floor(F.col(sample) / width).cast("int")
    rows = samples.withColumn("_e", epoch if offset is None else epoch + offset)
    stages = hyp.select(*keys, F.col("epoch").alias("_e"), "code")
    return rows.join(stages, [*keys, "_e"], "left").withColumn("code", F.coalesce("code", F.lit(-2))).drop("_e")


def alignment(recording_us: Column, hypnogram_us: Column, freq_sec: Column) -> Column:
    """Struct ``(offset, off_grid)``: epochs by which a recording starts after its hypnogram, rounded half to even."""
    exact = (recording_us - hypnogram_us) / (freq_sec * 1_000_000)
    return F.struct(F.bround(exact).cast("int").alias("offset"), (F.abs(exact - F.bround(exact)) > 1e-6).alias("off_grid"))


def runs(hyp: DataFrame, keys: Sequence[str], least: int = 1, equal_length: bool = False) -> DataFrame:
    """``(keys, value, start, length)``: runs of one code, at least ``least`` epochs long.

    equal_length: each run is cut into pieces of exactly ``least`` epochs, the
    remainder dropped.
    """
    w = _along(keys)
    new = F.when(F.col("code").eqNullSafe(F.lag("code").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = hyp.withColumn("_r", F.sum(new).over(w))
    found = rows.groupBy(*keys, "_r").agg(F.first("code").alias("value"), F.min("epoch").alias("start"), F.count(F.lit(1)).cast("int").alias("length")).drop("_r").where(F.col("length") >= least)
    if not equal_length:
        return found
    pieces = F.explode(F.sequence(F.lit(0), (F.floor(F.col("length") / least) - 1).cast("int")))
    return found.withColumn("_k", pieces).select(*keys, "value", (F.col("start") + F.col("_k") * least).alias("start"), F.lit(least).alias("length"))


def transitions(hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, from, to, n, p)``: counts of successive stages and their share of the row."""
    pairs = hyp.withColumn("_to", F.lead("code").over(_along(keys))).where("_to is not null")
    counts = pairs.groupBy(*keys, F.col("code").alias("from"), F.col("_to").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.try_divide("n", F.sum("n").over(Window.partitionBy(*keys, "from"))))


def stability(hyp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, stability)``: mean probability of staying, over the stages that are left or kept at least once."""
    t = transitions(hyp, keys)
    per = t.groupBy(*keys, "from").agg(F.sum(F.when(F.col("from") == F.col("to"), F.col("p")).otherwise(0.0)).alias("_p"))
    return per.groupBy(*keys).agg(F.avg("_p").alias("stability"))


def events(hyp: DataFrame, freq: Column, label: Column) -> DataFrame:
    """BIDS-like rows ``onset, duration, value, description`` beside the hypnogram's own columns."""
    return hyp.withColumns({"onset": F.col("epoch") * freq, "duration": freq, "value": F.col("code"), "description": label})


def sleep_statistics(hyp: DataFrame, keys: Sequence[str], freq: str = "freq_sec", stages: int = 5) -> DataFrame:
    """Summary of each five-stage hypnogram, one row a sequence; ``hyp`` carries the epoch length ``freq``.

    Minutes: TIB, SPT, WASO, TST, SOL, SOL_5min, WAKE, N1, N2, N3, REM, NREM,
    ART, UNS, Lat_N1, Lat_N2, Lat_N3, Lat_REM (from the first epoch);
    percentages of TST: pct_N1, pct_N2, pct_N3, pct_REM, pct_NREM; SE, SME; SFI
    as the reference prints it (transitions from sleep to wake per hour of
    sleep, divided once more by the epochs of a minute) and SFI_per_hour.
    Without sleep SPT and TST are 0 and everything relative to sleep is null.
    Values are rounded half to even at 4 digits.
    """
    w = _along(keys)
    asleep = F.col("code") > 0
    rows = hyp.select(*keys, "epoch", "code", F.col(freq).cast("double").alias("_freq"), F.lead("code").over(w).alias("_next"), F.row_number().over(w).alias("_i"))
    # runs of sleep: an epoch's number less its rank among the sleeping ones is constant in a run
    rank = F.sum(F.when(asleep, 1).otherwise(0)).over(w)
    rows = rows.withColumn("_run", F.when(asleep, F.col("_i") - rank))
    length = F.count("_run").over(Window.partitionBy(*keys, "_run"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumns({"_len": F.when(asleep, length), "_f": F.min(F.when(asleep, F.col("epoch"))).over(whole), "_l": F.max(F.when(asleep, F.col("epoch"))).over(whole)})
    first = lambda cond: F.min(F.when(cond, F.col("epoch")))
    count = lambda cond: F.count_if(cond)
    code = F.col("code")
    agg = rows.groupBy(*keys).agg(
        F.max("_freq").alias("_freq"), F.count(F.lit(1)).alias("_tib"), F.max("_f").alias("_f"), F.max("_l").alias("_l"), count(asleep).alias("_tst"),
        *[count(code == v).alias(f"_n{k}") for k, v in LABELS[5].items()],
        *[first(code == v).alias(f"_lat{k}") for k, v in (("N1", 1), ("N2", 2), ("N3", 3), ("REM", 4))],
        count(asleep & (F.col("_next") == 0)).alias("_frag"),
        first(asleep & (F.col("_len") * F.col("_freq") >= 300)).alias("_sol5"),
        count((code == 0) & F.col("epoch").between(F.col("_f"), F.col("_l"))).alias("_waso"),
    )
    m = F.col("_freq") / 60
    c = F.col
    spt = F.coalesce((c("_l") - c("_f") + 1) * m, F.lit(0.0))
    tst = c("_tst") * m
    some = c("_tst") > 0
    minutes = {
        "TIB": c("_tib") * m, "SPT": spt, "WASO": F.when(some, c("_waso") * m), "TST": tst, "SOL": c("_f") * m, "SOL_5min": c("_sol5") * m,
        **{k: c(f"_n{k}") * m for k in ("WAKE", "N1", "N2", "N3", "REM")},
        "NREM": (c("_nN1") + c("_nN2") + c("_nN3")) * m, "ART": c("_nART") * m, "UNS": c("_nUNS") * m,
        **{f"Lat_{k}": c(f"_lat{k}") * m for k in ("N1", "N2", "N3", "REM")},
        **{f"pct_{k}": F.try_divide(c(f"_n{k}") * 100.0, c("_tst")) for k in ("N1", "N2", "N3", "REM")},
        "pct_NREM": F.try_divide((c("_nN1") + c("_nN2") + c("_nN3")) * 100.0, c("_tst")),
        "SE": F.try_divide(tst * 100, c("_tib") * m), "SME": F.when(some, F.try_divide(tst * 100, spt)),
        "SFI_per_hour": F.try_divide(c("_frag").cast("double"), tst / 60), "SFI": F.try_divide(c("_frag").cast("double"), tst / 60) * m,
    }
    return agg.select(*keys, *[F.bround(v.cast("double"), 4).alias(k) for k, v in minutes.items()])


def stage_minutes(hyp: DataFrame, keys: Sequence[str], freq: str = "freq_sec") -> DataFrame:
    """``(keys, code, minutes)`` spent in each stage."""
    return hyp.groupBy(*keys, "code").agg((F.count(F.lit(1)) * F.max(freq) / 60).alias("minutes"))


def as_json(hyp: DataFrame, keys: Sequence[str], session: DataFrame, proba: str | None = None) -> DataFrame:
    """``(keys, json)``: each hypnogram as one object with values, n_stages, freq, start, scorer and proba.

    session: ``(keys, n_stages, freq_sec, start, scorer_name)``. proba: a column
    with each epoch's probabilities by label, written as a list a label, to six
    decimals; null without the column, or where an epoch has none. The values of
    a sequence are collected: a document is one string by nature.
    """
    types = "map<string,array<double>>"
    given = F.col(proba) if proba else F.lit(None).cast("map<string,double>")
    values = hyp.withColumn("_p", given).join(session.select(*keys, "n_stages"), list(keys)).select(*keys, F.struct("epoch", label_of(F.col("code"), F.col("n_stages")).alias("label"), F.map_entries("_p").alias("p")).alias("_s"))
    listed = values.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    labels = F.transform(F.col("_s")[0]["p"], lambda e: e["key"])
    of = lambda k: F.transform("_s", lambda s: F.round(F.try_element_at(F.map_from_entries(s["p"]), k), 6))
    whole = F.map_from_arrays(labels, F.transform(labels, of))
    listed = listed.select(*keys, F.transform("_s", lambda s: s["label"]).alias("values"), F.when(~F.exists("_s", lambda s: s["p"].isNull()), whole).cast(types).alias("proba")).join(session, list(keys))
    freq = F.concat(F.format_string("%d", F.col("freq_sec").cast("int")), F.lit("s"))
    doc = F.struct("values", "n_stages", freq.alias("freq"), "start", F.col("scorer_name").alias("scorer"), "proba")
    return listed.select(*keys, F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def from_json(docs: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, epoch, label, n_stages, freq, start, scorer_name, proba)`` from such objects; malformed ones give no rows."""
    schema = "values array<string>, n_stages int, freq string, start string, scorer string, proba map<string,array<double>>"
    d = docs.select(*keys, F.from_json(column, schema).alias("d"))
    rows = d.select(*keys, F.posexplode("d.values").alias("epoch", "label"), "d.n_stages", "d.freq", "d.start", F.col("d.scorer").alias("scorer_name"), F.col("d.proba").alias("_p"))
    return rows.withColumn("proba", F.transform_values("_p", lambda _, v: F.get(v, F.col("epoch")))).drop("_p")
