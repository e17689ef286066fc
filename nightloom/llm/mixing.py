"""Mixing sources to target weights.

Documents are counted by source and exact token length. What a source owes
beyond whole passes over itself is fitted on these counts: most of it is spread
over the lengths in proportion, the rest is a bounded-knapsack subset sum over
the counts still free, solved exactly with bit sets. The documents of each
length are then chosen by a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, cut
from .picking import pick


@dataclass(frozen=True)
class Mix:
    """picks: ``(doc, source, n_tokens, copies)``; shares: a row per target source with what was reached."""

    picks: DataFrame
    shares: DataFrame


def subset_sum(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take so that their sum is the greatest one not above ``goal``.

    Bounded knapsack by bit sets; lengths are tried in the given order and no
    more of them than needed. Zero lengths are never taken.
    """
    mask = (1 << (goal + 1)) - 1
    reach, states, used = 1, [1], []
    for i, (size, n) in enumerate(zip(lengths.tolist(), counts.tolist())):
        if reach >> goal & 1:
            break
        n = min(n, goal // size) if size > 0 else 0
        if n <= 0:
            continue
        used.append((i, size, n))
        step = 1
        while n > 0:
            step = min(step, n)
            reach |= reach << (step * size) & mask
            n -= step
            step *= 2
        states.append(reach)
    take = np.zeros(len(lengths), np.int64)
    at = reach.bit_length() - 1
    for (i, size, n), earlier in zip(reversed(used), reversed(states[:-1])):
        while not earlier >> at & 1:
            take[i] += 1
            at -= size
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int, slack: int) -> np.ndarray:
    """How many documents of each length to take for a sum as near below ``budget`` as can be.

    All but about ``slack`` tokens are spread in proportion to the counts (the
    error carried from length to length), so lengths keep their mixture; the
    subset sum settles the rest over lengths in a seeded order.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    order = np.argsort(-lengths, kind="stable")
    take = np.zeros(len(lengths), np.int64)
    rate, due, taken = max(0, budget - slack) / total, 0.0, 0
    if rate > 0:
        for i in order.tolist():
            due += rate * float(lengths[i] * counts[i])
            if lengths[i] > 0 and (n := min(int(counts[i]), int((due - taken) // lengths[i]))) > 0:
                take[i] = n
                taken += n * int(lengths[i])
    free = counts - take
    shuffled = np.random.default_rng(seed).permutation(len(lengths))
    take[shuffled] += subset_sum(lengths[shuffled], free[shuffled], budget - taken)
    return take


def mix(docs: DataFrame, targets: DataFrame, *, ident: str, source: str, size: str, total: int | None = None, fill: str = "gap", seed: int = 0, slack: int = 65_536) -> Mix:
    """Documents with their number of copies so that each source has its target share of ``total`` tokens.

    targets: ``(source, target_share, max_repeat)``. total: size of the mix,
    all tokens of the target sources unless given. A source's budget is
    ``floor(target_share * total)``; it is met by whole passes over the source
    and a fitted part of one more, no document more than max_repeat times. A
    source that can't reach its budget is taken max_repeat times whole, and its
    gap is reported, not filled from others; a source without documents is
    reported with zeros. fill: ``gap`` leaves the others' budgets as they are,
    so that their actual shares rise; ``shrink`` lowers the total until every
    source that has documents can reach its budget, so that shares hold among
    these. Runs jobs when called.

    Documents without tokens, id or source, and sources without a target, take
    no part; an id seen again counts once (its greatest source and size).
    Negative or null shares and repeats count as 0; a target named twice counts
    by its greatest share and repeat. Empty tables give empty picks.
    """
    settled = docs.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("doc")).agg(F.max(F.struct(F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens"))).alias("r"))
    sized = settled.select("doc", "r.source", "r.n_tokens").where("source is not null and n_tokens > 0")
    floor0 = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0)), F.lit(0))
    wanted = targets.where("source is not null").groupBy("source").agg(floor0("target_share").cast("double").alias("target_share"), floor0("max_repeat").cast("bigint").alias("max_repeat"))
    sized = cut(sized.join(bounded(wanted.select("source")), "source", "left_semi"))

    counts = cut(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    have = counts.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("available"))
    plan = wanted.join(bounded(have), "source", "left").fillna(0, ["n_docs", "available"])
    if total is None:
        total = have.agg(F.sum("available")).first()[0] or 0
    if fill not in ("gap", "shrink"):
        raise ValueError(fill)
    if fill == "shrink":
        most = plan.where("available > 0 and target_share > 0").agg(F.min(F.floor(F.col("max_repeat") * F.col("available") / F.col("target_share")))).first()[0]
        total = min(int(total), int(most or 0))
    plan = plan.withColumn("budget", F.floor(F.col("target_share") * F.lit(int(total))))
    passes = F.when(F.col("available") > 0, F.least("max_repeat", F.floor(F.col("budget") / F.col("available")))).otherwise(0)
    plan = plan.withColumn("passes", passes.cast("bigint"))
    plan = plan.withColumn("rest", F.when(F.col("passes") < F.col("max_repeat"), F.least(F.col("budget") - F.col("passes") * F.col("available"), F.col("available"))).otherwise(0))
    plan = cut(plan)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n_tokens", ignore_index=True)
        pdf["take"] = fit_budget(pdf["n_tokens"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]), seed, slack)
        return pdf[["source", "n_tokens", "take"]]

    fitted = counts.join(bounded(plan.select("source", "rest")), "source").where("rest > 0").groupBy("source").applyInPandas(fit, f"source {dict(counts.dtypes)['source']}, n_tokens bigint, take bigint")
    fitted = cut(fitted)
    rows = sized.join(bounded(plan.select("source", "passes")), "source").join(bounded(fitted), ["source", "n_tokens"], "left")
    rows = pick(rows, ["source", "n_tokens"], "doc", "take", seed)
    copies = F.col("passes") + F.col("picked").cast("bigint")
    picks = rows.select(F.col("doc").alias(ident), "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")

    part = fitted.groupBy("source").agg(F.sum(F.col("take") * F.col("n_tokens")).alias("part"), F.sum("take").alias("more"))
    told = plan.join(bounded(part), "source", "left").fillna(0, ["part", "more"])
    told = told.withColumn("mixed_tokens", F.col("passes") * F.col("available") + F.col("part"))
    all_tokens = told.agg(F.sum("mixed_tokens")).first()[0] or 0
    shares = told.select(
        "source", "target_share", "max_repeat", "n_docs", F.col("available").alias("available_tokens"), F.col("budget").alias("budget_tokens"), "mixed_tokens",
        (F.col("passes") * F.col("n_docs") + F.col("more")).alias("copies"),
        F.try_divide("mixed_tokens", F.lit(int(all_tokens))).alias("actual_share"),
        (F.col("budget") - F.col("mixed_tokens")).alias("missing_tokens"),
    )
    return Mix(picks, shares)
