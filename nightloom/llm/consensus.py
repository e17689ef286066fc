"""Consensus of several annotators' labels.

A competence-and-spamming mixture: with the probability of an annotator's
competence a label is the truth, else it is drawn from that annotator's guess
distribution. Expectation-maximisation yields both and the truth of each item.
With ``habits`` the guesses may depend on the true label, drawn towards the
annotator's overall guesses with the weight of some pseudo-labels; that is what
tells an annotator who always mistakes one label for another from a spammer.

The likelihood of an item depends only on who gave it which label. Up to
:data:`LISTED_ANNOTATORS` annotators their parameters travel to the tasks: items
become sorted lists of codes, equal lists are counted, and a round of EM is one
pass of NumPy over the counted lists, laid out once in blocks. Beyond, lists of
an item's votes and the table of annotators have no bound, so parameters are
joined to the votes and sums are taken by shuffles; both give the same.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: So many annotators have their parameters (a number per pair of labels each) sent to the tasks, and collected.
LISTED_ANNOTATORS = 20_000
#: Votes of one annotator that one task may join to its parameters, where these are joined.
LOT = 1_000_000


@dataclass(frozen=True)
class Consensus:
    """items: ``(item keys, n_votes, n_labels, agreement, label, confidence)``; annotators: ``(annotator, n_votes, competence, accuracy, guesses)``."""

    items: DataFrame
    annotators: DataFrame
    rounds: int
    converged: bool


def mixture_step(counts: np.ndarray, theta: np.ndarray, guess: np.ndarray, smooth: float | None) -> tuple[np.ndarray, np.ndarray]:
    """New ``(competence [A], guess [A, K, K])`` from expected counts ``[A, K true, K given]`` and the old ones.

    smooth: null keeps one guess distribution for all true labels; a number
    lets it depend on the true label, with so many pseudo-labels drawn from the
    annotator's overall guesses.
    """
    k = counts.shape[1]
    eye = np.arange(k)
    right = counts[:, eye, eye]
    known = theta[:, None] / (theta[:, None] + (1 - theta[:, None]) * guess[:, eye, eye])
    truthful = right * known
    guessed = counts.copy()
    guessed[:, eye, eye] -= truthful
    new_theta = (truthful.sum(1) + 0.5) / (counts.sum((1, 2)) + 1.0)
    overall = guessed.sum(1) + 0.5
    overall /= overall.sum(1, keepdims=True)
    if smooth is None:
        return new_theta, np.repeat(overall[:, None, :], k, 1)
    return new_theta, (guessed + smooth * overall[:, None, :]) / (guessed.sum(2, keepdims=True) + smooth)


def leap(p: np.ndarray, p1: np.ndarray, p0: np.ndarray, k: int, alpha: float) -> np.ndarray:
    """Parameters ``[A, 1 + k * k]`` carried on from three successive rounds ``p0``, ``p1``, ``p`` with the step ``alpha`` <= -1; -1 gives ``p``."""
    new = p0 - 2 * alpha * (p1 - p0) + alpha * alpha * (p - 2 * p1 + p0)
    guess = np.clip(new[:, 1:], 1e-9, None).reshape(-1, k, k)
    guess /= guess.sum(2, keepdims=True)
    return np.concatenate([np.clip(new[:, :1], 1e-4, 1 - 1e-4), guess.reshape(len(guess), -1)], 1)


def stepped(p: np.ndarray, before: np.ndarray, counts: np.ndarray, smooth: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New parameters ``[A, 1 + K * K]``, how far each annotator's accuracy moved, and both squared differences of SQUAREM."""
    k = counts.shape[1]
    eye = np.arange(k)
    theta, guess = mixture_step(counts, p[:, 0], p[:, 1:].reshape(-1, k, k), smooth)
    share = counts.sum(2) / np.maximum(counts.sum((1, 2)), 1e-12)[:, None]
    hit = lambda t, g: ((t[:, None] + (1 - t[:, None]) * g[:, eye, eye]) * share).sum(1)
    moved = np.abs(hit(theta, guess) - hit(p[:, 0], p[:, 1:].reshape(-1, k, k)))
    new = np.concatenate([theta[:, None], guess.reshape(len(guess), -1)], 1)
    return new, moved, ((p - before) ** 2).sum(1), ((new - 2 * p + before) ** 2).sum(1)


class Pace:
    """When rounds end, and where an extrapolation follows one.

    From the eighth round after the plain ones on, every second one is followed
    by an extrapolation, which has the same fixed points in fewer rounds.
    """

    def __init__(self, k: int, tolerance: float, plain_rounds: int):
        self.tolerance, self.plain = tolerance, plain_rounds
        self.prior = np.full(k, 1.0 / k)
        self.priors, self.since, self.done, self.converged = [self.prior, self.prior], -6, 0, False

    def after(self, moved: float | None, rr: float | None, vv: float | None, mass: np.ndarray | None, rounds: int) -> float | None:
        """Takes a round's outcome; the step of the extrapolation to make, if one is due."""
        self.done += 1
        if moved is None:
            self.converged = True
            return None
        self.prior = (mass + 0.5) / (mass + 0.5).sum()
        self.priors = [*self.priors, self.prior][-3:]
        if moved < self.tolerance and self.done > self.plain + 1:
            self.converged = True
            return None
        self.since += self.done > self.plain
        if self.since != 2 or self.done >= rounds:
            return None
        first, second, third = self.priors
        r, v = rr + ((second - first) ** 2).sum(), vv + ((third - 2 * second + first) ** 2).sum()
        alpha = -min(max(float(np.sqrt(r / max(v, 1e-300))), 1.0), 30.0)
        self.prior = np.clip(first - 2 * alpha * (second - first) + alpha * alpha * (third - 2 * second + first), 1e-6, None)
        self.prior /= self.prior.sum()
        self.priors, self.since = [*self.priors[:2], self.prior], 0
        return alpha


def log_given(p: np.ndarray, k: int) -> np.ndarray:
    """Log probability ``[A * K given, K true]`` of giving a label, by code (annotator * K + label)."""
    theta, guess = p[:, 0], p[:, 1:].reshape(-1, k, k)
    given = (1 - theta)[:, None, None] * guess
    given[:, np.arange(k), np.arange(k)] += theta[:, None]
    return np.log(np.maximum(given, 1e-300)).transpose(0, 2, 1).reshape(-1, k)


def posterior(codes: np.ndarray, starts: np.ndarray, table: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posterior ``[lists, K]`` of lists of codes that begin at ``starts``; no list is empty."""
    s = np.add.reduceat(table[codes], starts, axis=0) + np.log(prior)
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _lists(batch: pa.RecordBatch, name: str, hashes: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lengths of a column of lists of ``hash << bits | label``."""
    col = batch.column(name)
    packed = col.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    return (np.searchsorted(hashes, packed >> bits) * k + (packed & ((1 << bits) - 1))).astype(np.int32), lengths.astype(np.int32)


def consensus(
    votes: DataFrame,
    item: Sequence[str],
    annotator: str,
    label: str,
    n_labels: int,
    *,
    version: str | None = None,
    habits: float | None = 30.0,
    plain_rounds: int = 6,
    rounds: int = 1000,
    tolerance: float = 1e-5,
    listed: int = LISTED_ANNOTATORS,
) -> Consensus:
    """Most probable label of each item, how far its annotators agree, and each annotator's reliability.

    votes: ``label`` a whole number 0..n_labels-1. Rows with a null annotator
    or label, or a label outside the range, are no vote; a null part of the item
    key is a value. A repeated vote counts once. An annotator who gave an item
    several labels has voted for each, unless ``version`` names a timestamp:
    then the last row counts, whether it holds a vote or none (of equal
    versions the greatest label). Items with one vote keep it but teach nothing
    about annotators. Ties of the posterior go to the smaller label. An empty
    table gives empty results. agreement is the share of agreeing pairs among an
    item's pairs of votes, null for one vote.

    habits: null is the plain mixture, one guess distribution an annotator; a
    number lets guesses depend on the true label after ``plain_rounds`` rounds,
    with so many pseudo-labels drawn from the annotator's overall guesses.
    Rounds stop when no annotator's competence-weighted accuracy moves by
    ``tolerance`` or more; if it still does after ``rounds``, there is a warning
    and ``converged`` is false.

    Runs jobs when called: annotators are counted, items and their counted
    lists are written, and each round is a job. More than ``listed`` annotators
    are kept in a table and joined, with the same result.
    """
    k = n_labels
    code = F.when(F.col(label).between(0, k - 1), F.col(label).cast("int"))
    keys = [f"_k{i}" for i in range(len(item))]
    raw = votes.select(*[F.col(c).alias(n) for c, n in zip(item, keys)], F.col(annotator).alias("_a"), *([F.col(version).alias("_v")] if version else []), code.alias("_l")).where(F.col("_a").isNotNull())
    raw = raw if version else raw.where("_l is not null")
    few = raw.groupBy("_a").agg(F.count(F.lit(1)).alias("n")).limit(listed + 1).count() <= listed
    pace = Pace(k, tolerance, plain_rounds)
    items, who, prior = (_listed if few else _joined)(raw, keys, k, version, pace, habits, rounds)
    if not pace.converged:
        warnings.warn(f"consensus not converged after {pace.done} rounds", stacklevel=2)
    items = items.select(*[F.col(n).alias(c) for c, n in zip(item, keys)], "n_votes", "n_labels", "agreement", "label", "confidence")
    who = who.select(F.col("_a").alias(annotator), "n_votes", F.col("p")[0].alias("competence"), _accuracy(prior, k).alias("accuracy"), F.slice("p", 2, k * k).alias("guesses"))
    return Consensus(items, who, pace.done, pace.converged)


def _settled(raw: DataFrame, keys: list[str], k: int, version: str | None) -> DataFrame:
    """``(keys, _l)``, each vote once."""
    if version is None:
        return raw.select(*keys, "_l").distinct()
    at = F.coalesce(F.unix_micros(F.col("_v").cast("timestamp")), F.lit(-(1 << 50)))
    # one packed number: its plain maximum is hashed where that of a struct is sorted
    last = raw.groupBy(*keys).agg(F.max(at * (k + 1) + F.coalesce("_l", F.lit(-1)) + 1).alias("p"))
    return last.select(*keys, (F.pmod("p", F.lit(k + 1)) - 1).cast("int").alias("_l")).where("_l >= 0")


def _accuracy(prior: np.ndarray, k: int) -> Column:
    """Probability of the true label under the competence and the guesses in ``p``."""
    weight = np.asarray(prior).tolist()
    hit = lambda t: F.lit(weight[t]) * (F.col("p")[0] + (1 - F.col("p")[0]) * F.col("p")[1 + t * k + t])
    return sum((hit(t) for t in range(1, k)), hit(0))


def _start(k: int) -> list[float]:
    return [0.7, *np.full(k * k, 1.0 / k).tolist()]


def _listed(raw: DataFrame, item: list[str], k: int, version: str | None, pace: Pace, habits: float | None, rounds: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """EM with the parameters of all annotators in every task."""
    bits = max(1, (k - 1).bit_length())
    # rows go to their item at once; settling them and gathering its list then need no further shuffle
    one = _settled(raw.repartition(*item), [*item, "_a"], k, version)
    packed = F.shiftleft(F.xxhash64("_a"), bits).bitwiseOR(F.col("_l").cast("bigint"))
    items = cut(one.groupBy(*item).agg(F.array_sort(F.collect_set(packed)).alias("_c")))
    counted = items.where(F.size("_c") > 1).groupBy("_c").agg(F.count(F.lit(1)).alias("n"))
    seen = items.select(F.explode("_c").alias("c")).groupBy(F.shiftright("c", bits).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    known = sorted((r.h, r.n) for r in seen.collect())  # as many as annotators, at most ``listed``
    hashes, size = np.array([h for h, _ in known], np.int64), len(known)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, lengths = _lists(batch, "_c", hashes, bits, k)
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (codes, lengths, n)], names=["codes", "lengths", "n"])

    blocks = cut(counted.mapInArrow(lay, "codes binary, lengths binary, n binary"))

    def expect(table: np.ndarray, prior: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, mass = np.zeros((size * k, k)), np.zeros(k)
            for batch in batches:
                for codes, lengths, n in zip(*(batch.column(c).to_pylist() for c in ("codes", "lengths", "n"))):
                    codes, lengths, n = np.frombuffer(codes, np.int32), np.frombuffer(lengths, np.int32), np.frombuffer(n, np.int64)
                    w = posterior(codes, np.cumsum(lengths) - lengths, table, prior) * n[:, None]
                    mass += w.sum(0)
                    votes = np.repeat(w, lengths, axis=0)
                    for t in range(k):
                        sums[:, t] += np.bincount(codes, weights=votes[:, t], minlength=size * k)
            used = np.flatnonzero(sums.any(1))
            rows = np.concatenate([sums[used], mass[None]])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int64()), *[pa.array(rows[:, t]) for t in range(k)]], names=["code", *[f"w{t}" for t in range(k)]])

        return work

    fields = "code bigint, " + ", ".join(f"w{t} double" for t in range(k))
    p = np.tile(_start(k), (size, 1))
    p1 = p0 = p
    taught = np.zeros(size, bool)
    while pace.done < rounds and not pace.converged:
        told = blocks.mapInArrow(expect(log_given(p, k), pace.prior), fields).groupBy("code").agg(*[F.sum(f"w{t}").alias(f"w{t}") for t in range(k)]).collect()
        counts, mass = np.zeros((size * k, k)), np.zeros(k)
        for code, *w in told:
            if code < 0:
                mass[:] = w
            else:
                counts[code] = w
        if not mass.any():  # no item has two votes
            pace.after(None, None, None, None, rounds)
            break
        smooth = None if pace.done < pace.plain else habits
        new, moved, rr, vv = stepped(p, p1, counts.reshape(size, k, k).transpose(0, 2, 1), smooth)
        taught = counts.reshape(size, -1).any(1)  # the others keep what they began with
        p1, p0, p = p, p1, np.where(taught[:, None], new, p)
        alpha = pace.after(moved[taught].max(), rr[taught].sum(), vv[taught].sum(), mass, rounds)
        if alpha is not None:
            p = p1 = p0 = np.where(taught[:, None], leap(p, p1, p0, k, alpha), p)
    table, prior = log_given(p, k), pace.prior

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, lengths = _lists(batch, "_c", hashes, bits, k)
            starts = np.cumsum(lengths) - lengths
            given = np.stack([np.add.reduceat((codes % k == t).astype(np.int64), starts) for t in range(k)], 1)
            post = posterior(codes, starts, table, prior)
            several = lengths > 1
            pairs = np.where(several, (given * (given - 1)).sum(1) / np.maximum(lengths * (lengths - 1), 1), 0.0)
            told = [
                pa.array(lengths.astype(np.int64)),
                pa.array((given > 0).sum(1).astype(np.int32)),
                pa.array(pairs, mask=~several),
                pa.array(np.where(several, post.argmax(1), given.argmax(1)).astype(np.int32)),
                pa.array(post.max(1), mask=~several),
            ]
            yield pa.RecordBatch.from_arrays([*batch.select(item).columns, *told], names=[*item, "n_votes", "n_labels", "agreement", "label", "confidence"])

    keys = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in item)
    result = items.mapInArrow(settle, f"{keys}, n_votes bigint, n_labels int, agreement double, label int, confidence double")
    names = one.select("_a").distinct().select("_a", F.shiftright(F.shiftleft(F.xxhash64("_a"), bits), bits).alias("h"))
    rows = [(h, n, p[i].tolist() if taught[i] else None) for i, (h, n) in enumerate(known)]
    learnt = raw.sparkSession.createDataFrame(rows, "h bigint, n_votes bigint, p array<double>")
    return result, names.join(F.broadcast(learnt), "h"), prior


def _joined(raw: DataFrame, item: list[str], k: int, version: str | None, pace: Pace, habits: float | None, rounds: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """EM with parameters joined to the votes; an annotator's votes are spread over lots, an item's are only summed."""
    votes = cut(_settled(raw, [*item, "_a"], k, version).withColumn("_i", F.struct(*item)))
    per_label = [F.sum(F.when(F.col("_l") == i, 1).otherwise(0)).alias(f"c{i}") for i in range(k)]
    items = cut(votes.groupBy("_i").agg(F.count(F.lit(1)).alias("n_votes"), *per_label))
    several = items.where("n_votes > 1").select("_i")
    counted = cut(votes.groupBy("_a").agg(F.count(F.lit(1)).alias("n_votes")).withColumn("lots", F.ceil(F.col("n_votes") / LOT)))
    v = votes.select("_i", "_a", "_l").join(several.hint("merge"), "_i").join(counted.select("_a", "lots").hint("merge"), "_a")
    v = cut(v.select("_i", "_a", "_l", F.pmod(F.xxhash64("_i"), "lots").alias("lot")))
    start = F.array(*map(F.lit, _start(k)))
    params = v.select("_a").distinct().join(counted.hint("merge"), "_a").select("_a", "lots", *[start.alias(c) for c in ("p", "p1", "p0")])
    kind = dict(v.dtypes)["_a"]
    state = f"_a {kind}, lots bigint, p array<double>, p1 array<double>, p0 array<double>"
    given = lambda t: F.try_element_at("p", F.col("_l") + (2 + t * k)) * (1 - F.col("p")[0]) + F.when(F.col("_l") == t, F.col("p")[0]).otherwise(0.0)
    normed = F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    raised = F.transform("s", lambda x: F.exp(x - F.array_max("s")))
    counts = F.array(*[F.sum(F.when(F.col("_l") == g, F.col("post")[t]).otherwise(0.0)) for t in range(k) for g in range(k)])

    def posteriors(params: DataFrame, prior: np.ndarray) -> DataFrame:
        lots = params.select("_a", "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot"))
        met = v.join(lots.hint("merge"), ["_a", "lot"])
        s = met.groupBy("_i").agg(F.array(*[F.sum(F.log(given(t))) + F.lit(float(np.log(prior[t]))) for t in range(k)]).alias("s"))
        return s.withColumn("e", raised).select("_i", normed.alias("post"))

    def improve(smooth: float | None):
        def work(batches):
            for pdf in batches:
                if len(pdf):
                    of = lambda c: np.array(pdf[c].tolist(), float)
                    p, p1, c = of("p"), of("p1"), of("counts").reshape(-1, k, k)
                    new, moved, rr, vv = stepped(p, p1, c, smooth)
                    yield pd.DataFrame({"_a": pdf["_a"], "lots": pdf["lots"], "p": list(new), "p1": list(p), "p0": list(p1), "moved": moved, "rr": rr, "vv": vv})

        return work

    def carry(alpha: float):
        def work(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(p=list(leap(*(np.array(pdf[c].tolist(), float) for c in ("p", "p1", "p0")), k, alpha)))

        return work

    while pace.done < rounds and not pace.converged:
        post = cut(posteriors(params, pace.prior))
        sums = v.join(post.hint("merge"), "_i").groupBy("_a").agg(counts.alias("counts"))
        smooth = None if pace.done < pace.plain else habits
        params = cut(sums.join(params.hint("merge"), "_a").mapInPandas(improve(smooth), f"{state}, moved double, rr double, vv double"))
        moved, rr, vv = params.agg(F.max("moved"), F.sum("rr"), F.sum("vv")).first()
        mass = post.agg(*[F.sum(F.col("post")[t]) for t in range(k)]).first() if moved is not None else None
        alpha = pace.after(moved, rr, vv, np.array(mass, float) if mass else None, rounds)
        params = params.select("_a", "lots", "p", "p1", "p0")
        if alpha is not None:
            params = params.mapInPandas(carry(alpha), state)
    met = items.join(posteriors(params, pace.prior).hint("merge"), "_i", "left")
    given_to = [F.col(f"c{i}") for i in range(k)]
    pairs = sum((c * (c - 1) for c in given_to[1:]), given_to[0] * (given_to[0] - 1))
    alone = sum((F.when(c > 0, i).otherwise(0) for i, c in enumerate(given_to)), F.lit(0))
    result = met.select(
        *[F.col(f"_i.{c}").alias(c) for c in item],
        "n_votes",
        sum(((c > 0).cast("int") for c in given_to[1:]), (given_to[0] > 0).cast("int")).alias("n_labels"),
        F.when(F.col("n_votes") > 1, pairs / (F.col("n_votes") * (F.col("n_votes") - 1))).alias("agreement"),
        F.coalesce(F.array_position("post", F.array_max("post")) - 1, alone).cast("int").alias("label"),
        F.array_max("post").alias("confidence"),
    )
    return result, counted.join(params.select("_a", "p").hint("merge"), "_a", "left"), pace.prior
