"""Named queries p3 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded
from ..stages import code_of, label_of
from ..tables import latest, table
from .consensus import Consensus, consensus
from .lookalike import alike_classes, alike_pairs, canonical_text
from .mixing import Mix, mix
from .nearest import microseconds, nearest_within
from .packing import filling, pack
from .runs import collapse_runs
from .tokens import with_token_counts

STAGES = ("WAKE", "N1", "N2", "N3", "REM")


def _hypnograms(spark: SparkSession, folder: str) -> DataFrame:
    """``(session_id, scorer, n_stages, freq_sec)``, one row per session and scorer."""
    return latest(table(spark, folder, "sleep_session"), ["session_id", "scorer"], "loaded_at", ["n_stages", "freq_sec"])


def _consensus(spark: SparkSession, folder: str) -> Consensus:
    """Votes of all five-stage hypnograms, with the scorers' habits; artefacts, unscored and unknown stages are none."""
    other = _hypnograms(spark, folder).where("n_stages <> 5").select("session_id", "scorer")
    rows = table(spark, folder, "hypnogram").select("session_id", "scorer", "epoch", "loaded_at", code_of(F.col("stage")).alias("code"))
    return consensus(rows.join(bounded(other, 100_000), ["session_id", "scorer"], "left_anti"), ["session_id", "epoch"], "scorer", "code", 5, version="loaded_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Stage of each epoch on which three or more scorers voted and differed: ``(session_id, epoch, stage)``."""
    items = _consensus(spark, folder).items.where("n_votes >= 3 and n_labels > 1")
    return items.select("session_id", "epoch", label_of(F.col("label"), 5).alias("stage"))


def p3_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Every voted epoch with its consensus stage, the scorers' agreement and the posterior probability."""
    items = _consensus(spark, folder).items
    return items.select("session_id", "epoch", "n_votes", "n_labels", "agreement", label_of(F.col("label"), 5).alias("stage"), "confidence")


def p3_scorers(spark: SparkSession, folder: str) -> DataFrame:
    """Every scorer's votes, competence, expected accuracy and guess distributions (true by given stage)."""
    return _consensus(spark, folder).annotators


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each slow wave with the nearest spindle within 1.2 s: ``(sw_id, spindle_id)``."""
    keys = ["recording_id", "channel"]
    waves = latest(table(spark, folder, "sw_event"), ["event_id"], "loaded_at", [*keys, "negpeak"])
    spindles = latest(table(spark, folder, "spindle_event"), ["event_id"], "loaded_at", [*keys, "start"])
    left = waves.select(*keys, F.col("event_id").alias("sw_id"), microseconds(F.col("negpeak")).alias("at"))
    right = spindles.select(*keys, F.col("event_id").alias("spindle_id"), microseconds(F.col("start")).alias("at"))
    met = nearest_within(left, right, keys, left_id="sw_id", left_time="at", right_id="spindle_id", right_time="at", tolerance=1_200_000)
    return met.select("sw_id", "spindle_id")


def _stretches(spark: SparkSession, folder: str, **limits) -> DataFrame:
    """Runs of stage codes (from 0, unscored) with the hypnogram's number of stages and epoch length."""
    epochs = table(spark, folder, "hypnogram").select("session_id", "scorer", "epoch", "loaded_at", (code_of(F.col("stage")) + 2).alias("code"))
    runs = collapse_runs(epochs, ["session_id", "scorer"], "epoch", "code", version="loaded_at", **limits)
    return runs.join(bounded(_hypnograms(spark, folder), 100_000), ["session_id", "scorer"])


#: How alike light and deep stages are to their neighbours, by code from 0 (N1 with N2, N2 with N3), for :func:`p5_bouts`.
ALIKE = {(3, 4): 0.8, (4, 3): 0.8, (4, 5): 0.9, (5, 4): 0.9}


def p5_bouts(spark: SparkSession, folder: str) -> DataFrame:
    """Near-identical stretches as one: neighbouring N1, N2 and N3, and two parts of one bout with one epoch missing between them.

    ``(session_id, scorer, first_epoch, last_epoch, stage, n_epochs)``, stage
    being that of the larger part each time two were merged. Hypnograms of five
    stages.
    """
    rows = _stretches(spark, folder, least=0.75, gap=2, similar=ALIKE).where("n_stages = 5")
    return rows.select("session_id", "scorer", F.col("first").cast("int").alias("first_epoch"), F.col("last").cast("int").alias("last_epoch"), label_of(F.col("label") - 2, 5).alias("stage"), F.col("n").cast("int").alias("n_epochs"))


def p5_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of one stage, single epochs too: the columns of :func:`p5_found`."""
    rows = _stretches(spark, folder).select("session_id", "scorer", F.col("first").cast("int").alias("first_epoch"), label_of(F.col("label") - 2, F.col("n_stages")).alias("stage"), F.col("n").cast("int").alias("n_epochs"), F.bround(F.col("n") * F.col("freq_sec")).cast("int").alias("duration_s"))
    return rows.where("stage is not null")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Longest stretches of two or more epochs in one stage."""
    return p5_runs(spark, folder).where("n_epochs >= 2")


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return with_token_counts(docs, "text").select("doc_id", "source", "n_tokens")


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container and place of every document, for each capacity of pack_capacity."""
    return pack(_sizes(spark, folder), table(spark, folder, "pack_capacity"), ident="doc_id", size="n_tokens")


def p6_filling(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of :func:`p6_packed` are filled."""
    return filling(p6_packed(spark, folder), table(spark, folder, "pack_capacity"))


def _mix(spark: SparkSession, folder: str) -> Mix:
    return mix(_sizes(spark, folder), table(spark, folder, "mix_target"), ident="doc_id", source="source", size="n_tokens")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents and how often each is taken."""
    return _mix(spark, folder).picks


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Each source's target, budget and the share it reached."""
    return _mix(spark, folder).shares


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that look the same and are different strings: ``(doc_id_a, doc_id_b)``."""
    return alike_pairs(table(spark, folder, "documents"), "doc_id", "text")


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the class of texts that look like it: ``(doc_id, class_id, n_members, n_links)``."""
    return alike_classes(table(spark, folder, "documents"), "doc_id", "text")


def p8_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text in canonical form."""
    return canonical_text(table(spark, folder, "documents").select("doc_id", "text"), "text", "canonical").select("doc_id", "canonical", (~F.col("text").eqNullSafe(F.col("canonical"))).alias("changed"))


QUERIES = {
    "p3_found": p3_found,
    "p3_epochs": p3_epochs,
    "p3_scorers": p3_scorers,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_runs": p5_runs,
    "p5_bouts": p5_bouts,
    "p6_packed": p6_packed,
    "p6_filling": p6_filling,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_canonical": p8_canonical,
}
