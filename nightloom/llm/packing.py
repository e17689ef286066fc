"""Filling fixed-capacity containers with items.

A grouping genetic algorithm: a solution is a set of bins. Crossover injects
whole well-filled bins of one parent into the other, drops the bins that hold a
duplicate, and puts their displaced items back by best fit. Items are hashed to
shards of bounded size; each shard is bred on several islands, and after every
epoch an island's best solution migrates to the next island. A shard that
reaches its lower bound is left in peace.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded, cut


def best_fit(sizes: np.ndarray, capacity: int, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
    """``bins`` with ``items`` (in this order) put where least room is left over; new bins get the next numbers."""
    placed = bins >= 0
    n = int(bins.max(initial=-1)) + 1
    fill = np.bincount(bins[placed], weights=sizes[placed], minlength=n).astype(np.int64)
    room = sorted((int(capacity - f), b) for b, f in enumerate(fill.tolist()) if f < capacity)
    out = bins.copy()
    for i, size in zip(items.tolist(), sizes[items].tolist()):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, n
            n += 1
        out[i] = b
        if left > size:
            insort(room, (left - size, b))
    return out


def dense(bins: np.ndarray) -> np.ndarray:
    """Bin numbers without gaps, in order of first use."""
    _, first, inverse = np.unique(bins, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    return rank[inverse]


def fitness(sizes: np.ndarray, capacity: int, bins: np.ndarray) -> float:
    """Mean square of the bins' filling: full bins beside empty ones beat evenly filled ones."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill**2).sum() / len(fill))


def crossover(sizes: np.ndarray, capacity: int, base: np.ndarray, donor: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """``base`` with some of the donor's best-filled bins injected whole."""
    fill = np.bincount(donor, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.2, 0.7))), replace=False)] = True
    injected = chosen[donor]
    hit = np.zeros(int(base.max()) + 1, bool)
    hit[base[injected]] = True
    displaced = hit[base] & ~injected
    child = np.where(injected, donor + int(base.max()) + 1, base)
    child[displaced] = -1
    return _refill(sizes, capacity, child, rng)


def mutate(sizes: np.ndarray, capacity: int, bins: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and a few others dissolved and filled anew."""
    fill = np.bincount(bins, weights=sizes)
    n = len(fill)
    gone = np.zeros(n, bool)
    gone[np.argsort(fill)[: max(1, n // 20)]] = True
    gone[rng.integers(0, n, max(1, n // 10))] = True
    child = bins.copy()
    child[gone[bins]] = -1
    return _refill(sizes, capacity, child, rng)


def _refill(sizes: np.ndarray, capacity: int, child: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    loose = child < 0
    child[~loose] = dense(child[~loose])
    items = np.flatnonzero(loose)
    noise = 1.0 if rng.random() < 0.5 else rng.uniform(0.9, 1.1, len(items))
    return dense(best_fit(sizes, capacity, child, items[np.argsort(-sizes[items] * noise, kind="stable")]))


def founders(sizes: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """First solutions: best fit by falling size, and by falling size with some noise."""
    empty = np.full(len(sizes), -1, np.int64)
    orders = [-sizes] + [-sizes * rng.uniform(0.8, 1.25, len(sizes)) for _ in range(size - 1)]
    return [dense(best_fit(sizes, capacity, empty, np.argsort(o, kind="stable"))) for o in orders]


def evolve(sizes: np.ndarray, capacity: int, population: list[np.ndarray], generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """``generations`` children by tournament, each replacing the worst if better; best first."""
    # no two items above half a container share one
    bound = max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))
    rated = sorted(((fitness(sizes, capacity, b), k, b) for k, b in enumerate(population)), key=lambda x: -x[0])
    for k in range(generations):
        if int(rated[0][2].max(initial=-1)) + 1 <= bound:
            break
        a, b = (min(rng.integers(0, len(rated), 2)) for _ in range(2))
        child = crossover(sizes, capacity, rated[a][2], rated[b][2], rng) if a != b else mutate(sizes, capacity, rated[a][2], rng)
        if rng.random() < 0.3:
            child = mutate(sizes, capacity, child, rng)
        score = fitness(sizes, capacity, child)
        if score > rated[-1][0]:
            rated[-1] = (score, k, child)
            rated.sort(key=lambda x: -x[0])
    return [b for _, _, b in rated]


#: Kinds of container that one explode lists; more take several.
_KINDS = 1000
_SHARD = "container string, capacity int, shard bigint, island int, sizes array<int>"


def pack(docs: DataFrame, containers: DataFrame, *, ident: str, size: str, shard_items: int = 2048, islands: int = 2, population: int = 6, epochs: int = 3, generations: int = 25, loose: float = 0.95, seed: int = 0) -> DataFrame:
    """Where every document goes, for each kind of container.

    containers: ``(container, capacity_tokens)``. Result: ``(container,
    bin_id, place, offset, ident, piece, piece_start, n_tokens)``: the document's
    piece fills ``n_tokens`` of the bin from ``offset`` on, at the 0-based
    ``place``. Only a document above the capacity has several pieces: full ones
    each in a bin of its own, and a last one that is packed like a document.

    A document without tokens gets one row per container with a null bin_id.
    Rows with a null id are dropped, an id seen again counts once (its greatest
    size); kinds with a null, zero or negative capacity hold nothing and are
    left out, one named twice counts with its greatest capacity. Shards hold
    about ``shard_items`` items by a hash of the id, at any size of the input.
    Bins filled to less than ``loose`` are mixed across shards at the end (0:
    none are). Runs jobs when called; the kinds of container are collected.
    """
    kinds = containers.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    listed = [tuple(r) for r in kinds.orderBy("container").collect()] or [(None, None)]
    whole = docs.where(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("doc")).agg(F.max(F.coalesce(F.col(size), F.lit(0))).cast("int").alias("size"))
    whole = cut(whole)
    n = max(1, whole.where("size > 0").count())
    shards = -(-n // shard_items)
    laid = None
    for at in range(0, len(listed), _KINDS):
        some = F.explode(F.array(*[F.struct(F.lit(name).cast("string").alias("container"), F.lit(cap).cast("int").alias("capacity")) for name, cap in listed[at : at + _KINDS]]))
        part = whole.withColumn("k", some).select("doc", "size", "k.container", "k.capacity").where("capacity is not null")
        laid = part if laid is None else laid.unionByName(part)
    full = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int")
    laid = laid.withColumn("full", full).withColumn("left", (F.col("size") - F.col("full") * F.col("capacity")).cast("int"))
    items = laid.where("left > 0").select("container", "capacity", F.pmod(F.xxhash64(F.lit(seed), "doc"), F.lit(shards)).alias("shard"), F.struct("left", "doc", "full").alias("item"))
    grouped = items.groupBy("container", "capacity", "shard").agg(F.sort_array(F.collect_list("item")).alias("items"))
    grouped = cut(grouped)

    states = grouped.select("container", "capacity", "shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.col("items.left").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("pool"))

    def breed(epoch: int):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pools, scores = [], []
                for capacity, shard, island, sizes, pool in zip(pdf["capacity"], pdf["shard"], pdf["island"], pdf["sizes"], pdf["pool"]):
                    sizes = np.asarray(sizes, np.int64)
                    rng = np.random.default_rng([seed, epoch, int(shard), int(island), int(capacity)])
                    start = founders(sizes, capacity, population, rng) if pool is None else [np.asarray(p, np.int64) for p in pool]
                    bred = evolve(sizes, capacity, start, generations, rng)
                    pools.append([b.astype(np.int32) for b in bred[:population]])
                    scores.append(fitness(sizes, capacity, bred[0]))
                yield pdf.assign(pool=pools, score=scores)

        return work

    on = ["container", "shard", "island"]
    tasks = max(1, shards * islands * len(listed) // 16)
    for epoch in range(epochs):
        # parallelism follows the number of shards, not their bytes, which are few
        states = states.repartition(tasks, "container", "shard", "island").mapInPandas(breed(epoch), f"{_SHARD}, pool array<array<int>>, score double")
        states = cut(states)
        if epoch + 1 < epochs:
            elite = states.select("container", "shard", ((F.col("island") + 1) % islands).alias("island"), F.col("pool")[0].alias("guest"))
            states = states.join(elite.hint("merge"), on).select("container", "capacity", "shard", "island", "sizes", F.concat(F.array("guest"), "pool").alias("pool"))
    best = states.groupBy("container", "shard").agg(F.max_by(F.col("pool")[0], F.struct("score", -F.col("island"))).alias("bins"))
    packed = grouped.join(best.hint("merge"), ["container", "shard"])
    each = packed.select("container", "capacity", "shard", F.inline(F.arrays_zip("items", "bins"))).select("container", "capacity", "shard", "items.*", "bins")

    def placed(rows: DataFrame, *bin_of: str) -> DataFrame:
        w = Window.partitionBy("container", *bin_of).orderBy(F.desc("left"), "doc")
        return rows.withColumns({"place": F.row_number().over(w) - 1, "offset": (F.sum("left").over(w) - F.col("left")).cast("int"), "fill": F.sum("left").over(Window.partitionBy("container", *bin_of))})

    each = cut(placed(each, "shard", "bins"))
    migrates = F.col("fill") < F.col("capacity") * F.lit(loose)
    told = lambda rows, bin_id: rows.select("container", bin_id.alias("bin_id"), "place", "offset", F.col("doc").alias(ident), F.col("full").alias("piece"), (F.col("full") * F.col("capacity")).alias("piece_start"), F.col("left").alias("n_tokens"))
    rows = told(each.where(~migrates), F.concat_ws(".", "shard", "bins"))
    moving = each.where(migrates)
    pools = moving.groupBy("container").agg(F.ceil(F.count(F.lit(1)) / shard_items).alias("pools"))
    pooled = moving.join(bounded(pools), "container").withColumn("pool", F.pmod(F.xxhash64(F.lit(seed), "shard"), "pools"))
    pooled = pooled.groupBy("container", "capacity", "pool").agg(F.sort_array(F.collect_list(F.struct("left", "doc", "full", "shard", "bins"))).alias("items"))
    pooled = cut(pooled)
    bins_of = F.transform("items", lambda x: F.concat_ws(".", x["shard"].cast("string"), x["bins"].cast("string")))

    def remix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for capacity, pool, sizes, old in zip(pdf["capacity"], pdf["pool"], pdf["sizes"], pdf["old"]):
                sizes = np.asarray(sizes, np.int64)
                rng = np.random.default_rng([seed, epochs, int(pool), int(capacity)])
                came = dense(pd.factorize(np.asarray(old, object))[0].astype(np.int64))
                bred = evolve(sizes, capacity, [came, *founders(sizes, capacity, population, rng)], epochs * generations, rng)
                found.append(min([came, *bred], key=lambda b: (int(b.max(initial=-1)), -fitness(sizes, capacity, b))).astype(np.int32))
            yield pdf[["container", "pool"]].assign(mixed=found)

    mixed = pooled.select("container", "capacity", "pool", F.col("items.left").alias("sizes"), bins_of.alias("old"))
    mixed = mixed.repartition(tasks, "container", "pool").mapInPandas(remix, "container string, pool bigint, mixed array<int>")
    met = pooled.join(mixed.hint("merge"), ["container", "pool"]).select("container", "capacity", "pool", F.inline(F.arrays_zip("items", "mixed"))).select("container", "capacity", "pool", "items.left", "items.doc", "items.full", "mixed")
    rows = rows.unionByName(told(placed(met, "pool", "mixed"), F.concat_ws(".", F.lit("mixed"), "pool", "mixed")))
    cut_up = laid.where("full > 0").select("container", "capacity", "doc", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    cut_up = cut_up.select("container", F.concat_ws(".", F.lit("doc"), F.col("doc").cast("string"), "piece").alias("bin_id"), F.lit(0).alias("place"), F.lit(0).alias("offset"), F.col("doc").alias(ident), "piece", (F.col("piece") * F.col("capacity")).alias("piece_start"), F.col("capacity").alias("n_tokens"))
    none = laid.where("size = 0").select("container", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("offset"), F.col("doc").alias(ident), F.lit(0).alias("piece"), F.lit(0).alias("piece_start"), F.lit(0).alias("n_tokens"))
    return rows.unionByName(cut_up).unionByName(none)


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """``(container, capacity, bins, tokens, fill, least_bins)`` of a packing; least_bins is what its tokens need at best."""
    kinds = containers.where("container is not null and capacity_tokens > 0").groupBy("container").agg(F.max("capacity_tokens").cast("int").alias("capacity"))
    bins = packed.where("bin_id is not null").groupBy("container", "bin_id").agg(F.sum("n_tokens").alias("tokens"))
    told = bins.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    met = kinds.join(bounded(told), "container", "left").fillna(0, ["bins", "tokens"])
    return met.select("container", "capacity", "bins", "tokens", F.try_divide("tokens", F.col("bins") * F.col("capacity")).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_bins"))
