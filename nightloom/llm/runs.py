"""Collapsing runs of identical or near-identical consecutive events.

Adjacent agglomeration: the runs of an entity form a linked list, a priority
queue holds neighbouring pairs, and the most similar pair is merged again and
again until none meets the limits of similarity and gap. Equal and
near-identical neighbours alike are merged this way.

Entities are worked in slices of the order column, which bounds a task's rows.
A stretch is what could merge at all: no step in it exceeds the gap, and its
labels are linked by similarity, which merging never changes. A stretch inside
a slice is agglomerated there; one that touches the slice's edge waits for a
slice 4096 times as wide, with its equal neighbours merged where these go
before all others. The outcome is that of the whole list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import changes, whole_groups
from ..session import cut


def agglomerate(entity: np.ndarray, first: np.ndarray, last: np.ndarray, count: np.ndarray, label: np.ndarray, *, least: float = 1.0, gap: int = 1, similar: Mapping[tuple[int, int], float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(index of the first member, last, count, label)`` of rows sorted by entity and ``first``.

    Neighbours can merge when they are of one entity, neither label is negative
    (no label), ``next.first - last <= gap``, and the similarity of their
    labels is ``least`` or more: 1 for equal labels, else what ``similar`` says
    of the ordered pair (0 if nothing). The most similar pair goes first, then
    the smaller gap, then the earlier. A merged run keeps the label of the part
    with more events, of equal ones the earlier.
    """
    n = len(first)
    close, equal = np.zeros(n + 1, bool), np.zeros(n, bool)
    close[1:n] = (entity[1:] == entity[:-1]) & (label[1:] >= 0) & (label[:-1] >= 0) & (first[1:] - last[:-1] <= gap)
    equal[1:] = close[1:n] & (label[1:] == label[:-1])
    # a pair is known by its right run: merging changes neither the gap before it nor its place
    space = np.zeros(n, np.int64)
    space[1:] = np.unique(np.maximum(first[1:] - last[:-1], 0), return_inverse=True)[1]
    place = space * n + np.arange(n)
    likes = {(a, b): x for (a, b), x in (similar or {}).items() if a != b and x >= least}
    tier = {x: i * n * n for i, x in enumerate(sorted({1.0, 0.0, *likes.values()}, reverse=True))}
    table = {pair: tier[x] for pair, x in likes.items()}
    other, same = (tier[x] if x >= least else None for x in (0.0, 1.0))

    g, c, at, may = label.tolist(), count.tolist(), place.tolist(), close.tolist()
    keys = np.full(n, -1) if same is None else np.where(equal, place + same, -1)
    for j in np.flatnonzero(close[:n] & ~equal).tolist() if table or other is not None else ():
        if (t := table.get((g[j - 1], g[j]), other)) is not None:
            keys[j] = t + at[j]
    now = keys.tolist()  # the key by which a pair is in the queue; entries with another are out of date
    queue = np.sort(keys[keys >= 0]).tolist()  # sorted, so a heap
    nxt, prv = list(range(1, n + 1)), list(range(-1, n))
    alive = bytearray(b"\x01") * n

    def ranked(j: int, a: int, b: int) -> None:
        """Queues run ``j`` (label ``b``) with the one before it (label ``a``) by their similarity."""
        t = same if a == b else table.get((a, b), other)
        key = -1 if t is None else t + at[j]
        if key != now[j]:
            now[j] = key
            if key >= 0:
                heapq.heappush(queue, key)

    while queue:
        key = heapq.heappop(queue)
        j = key % n
        if now[j] != key:
            continue
        now[j] = -1
        i, k = prv[j], nxt[j]
        a, b = g[i], g[j]
        if a != b and c[j] > c[i]:
            g[i] = b
        c[i] += c[j]
        alive[j] = 0
        nxt[i] = k
        prv[k] = i
        if g[i] != b and may[k]:
            ranked(k, g[i], g[k])
        if g[i] != a and may[i]:
            ranked(i, g[prv[i]], g[i])
    keep = np.flatnonzero(np.frombuffer(bytes(alive), np.uint8))
    return keep, last[np.array(nxt, np.int64)[keep] - 1], np.array(c, np.int64)[keep], np.array(g, np.int64)[keep]


def _linked(similar: Mapping[tuple[int, int], float] | None, least: float) -> dict[int, int]:
    """Each label's set of labels that similarity links, named by its smallest; labels alone are left out."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for (a, b), likeness in (similar or {}).items():
        if likeness >= least:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _settled(entity: np.ndarray, order: np.ndarray, version: np.ndarray | None, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each first ``(entity, order)`` of sorted rows, and the label of its last version (of equal ones the greatest)."""
    new = np.ones(len(order), bool)
    new[1:] = (order[1:] != order[:-1]) | (entity[1:] != entity[:-1])
    at = np.flatnonzero(new)
    if len(at) == len(order):
        return at, label
    if version is not None:
        latest = np.maximum.reduceat(version, at)[np.cumsum(new) - 1]
        label = np.where(version == latest, label, np.iinfo(label.dtype).min)
    return at, np.maximum.reduceat(label, at)


def _nearest_held(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the last held one before and the first one after each, -1 and the length where there is none."""
    i = np.arange(len(held))
    left = np.maximum.accumulate(np.where(held, i, -1)) if len(held) else i
    right = np.minimum.accumulate(np.where(held, i, len(held))[::-1])[::-1] if len(held) else i
    return left, right


def collapse_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    label: str,
    *,
    version: str | None = None,
    slice_width: int = 4096,
    least: float = 1.0,
    gap: int = 1,
    similar: Mapping[tuple[int, int], float] | None = None,
) -> DataFrame:
    """``(keys, first, last, n, label)``: the runs of each entity in order of the whole number ``order``.

    label: small whole numbers; null or negative is no label, such a row is in
    no run and ends one. gap: largest step between the orders of two merging
    neighbours (1: no number missing between them). least, similar: see
    :func:`agglomerate`; with the default only equal labels merge. A stretch of
    linked labels without a gap is one task's work, as the greedy order
    demands; unless ``similar`` has unlike labels as alike as equal ones, its
    equal neighbours are merged in each slice before.

    Of rows with equal ``(keys, order)`` one counts: the greatest label, or
    with ``version``, a timestamp, the last one's (null is oldest), be it null.
    Null keys are an entity; rows with a null order are dropped; single events
    are runs of one; an empty table gives an empty one. Columns not named are
    ignored. One job runs when called, for the range of ``order``; with orders
    in several slices two or three more.
    """
    types = dict(df.dtypes)
    names = [f"_k{i}" for i in range(len(keys))]
    at = F.lit(0).cast("bigint") if version is None else F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(1 << 62)))
    events = df.where(F.col(order).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(order).cast("bigint").alias("first"), at.alias("_v"), F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("label"))
    lo, hi = events.agg(F.min("first"), F.max("first")).first()
    linked = _linked(similar, least)
    equal_first = not any(a != b and likeness >= 1.0 for (a, b), likeness in (similar or {}).items())
    schema = ", ".join(f"{n} {types[k]}" for n, k in zip(names, keys)) + ", first bigint, last bigint, n bigint, label int, held boolean"

    def level(rows: DataFrame, width: int, raw: bool) -> tuple[DataFrame, bool]:
        """Runs of the rows by slices of ``width``, the last level if they all lie in one; raw: rows are events."""
        final = lo is None or width >= 1 << 60 or lo // width == hi // width
        part = F.lit(0).cast("bigint") if final else F.floor(F.col("first") / F.lit(width))
        # one number that sorts rows by entity, slice and place; equal hashes are told apart afterwards
        group = F.xxhash64(*names, "_part")
        span = (hi - lo if final else width - 1) if raw and lo is not None else 1 << 12
        bits = span.bit_length() if span < 1 << 12 else 0
        place = F.col("first") - (F.lit(lo) if final else F.col("_part") * width) if bits else F.lit(0)

        def work(batch: pa.RecordBatch, _: np.ndarray) -> Iterator[pa.RecordBatch]:
            col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            entity = np.cumsum(changes(batch, [*names, "_part"])) - 1
            first = col("first")
            if ((entity[1:] == entity[:-1]) & (first[1:] < first[:-1])).any() or len(pc.unique(batch.column("_z"))) != entity[-1] + 1:
                table = pa.Table.from_batches([batch])
                batch = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*names, "_part", "first")])).combine_chunks().to_batches()[0]
                entity, first = np.cumsum(changes(batch, [*names, "_part"])) - 1, col("first")
            if raw:
                keep, lab = _settled(entity, first, None if version is None else col("_v"), col("label"))
                last, count = first[keep], np.ones(len(keep), np.int64)
            else:
                keep, last, count, lab = np.arange(len(first)), col("last"), col("n"), col("label")
            entity, first = entity[keep], first[keep]
            last, count, lab = last.copy(), count.copy(), lab.copy()  # a batch's own columns can't be written to
            kind = lab
            if linked:
                seen, which = np.unique(lab, return_inverse=True)
                kind = np.array([linked.get(x, x) for x in seen.tolist()])[which]
            new = np.ones(len(first), bool)
            new[1:] = (entity[1:] != entity[:-1]) | (kind[1:] != kind[:-1]) | (lab[1:] < 0) | (first[1:] - last[:-1] > gap)
            stretch = np.cumsum(new) - 1
            held = np.zeros(len(first), bool)
            if not final:
                start = col("_part")[keep] * width
                touches = (first <= start + gap - 1) | (last >= start + width - gap)
                held = (np.bincount(stretch, weights=touches) > 0)[stretch]
                # what keeps two waiting runs apart waits with them
                left, right = _nearest_held(held)
                between = ~held & (left >= 0) & (right < len(held))
                l, r = np.maximum(left, 0), np.minimum(right, len(held) - 1)
                held |= between & (entity[l] == entity) & (entity[r] == entity) & (first[r] - last[l] <= gap)
            gone = np.zeros(len(first), bool)
            several = (np.bincount(stretch) > 1)[stretch]
            for some, limits in ((~held, {"least": least, "similar": similar}), (held & equal_first, {"least": max(least, 1.0)})):
                some = np.flatnonzero(some & several)
                left, l, c, g = agglomerate(stretch[some], first[some], last[some], count[some], lab[some], gap=gap, **limits)
                gone[some] = True
                some = some[left]
                gone[some], last[some], count[some], lab[some] = False, l, c, g
            keep, first, last, count, lab, held = (x[~gone] for x in (keep, first, last, count, lab, held))
            good = (lab >= 0) | held
            told = [pa.array(first[good]), pa.array(last[good]), pa.array(count[good]), pa.array(lab[good].astype(np.int32)), pa.array(held[good])]
            yield pa.RecordBatch.from_arrays([*batch.select(names).take(pa.array(keep[good])).columns, *told], names=[*names, "first", "last", "n", "label", "held"])

        def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.set_column(batch.schema.get_field_index("_z"), "_z", pc.shift_right(batch.column("_z"), bits))

        fields = ["_part", "first", *(["_v"] if raw else ["last", "n"]), "label"]
        laid = rows.withColumn("_part", part).withColumn("_z", F.shiftleft(group, bits).bitwiseOR(place.cast("bigint")))
        laid = laid.repartition(*names, "_part").sortWithinPartitions("_z").select(*names, "_z", *fields)
        return laid.mapInArrow(lambda batches: whole_groups(ordered(batches), ["_z"], work), schema), final

    runs, final = level(events, slice_width, True)
    width, done = slice_width, []
    while not final:
        runs = cut(runs)
        done.append(runs.where("not held"))
        width *= 4096
        runs, final = level(runs.where("held"), width, False)
    for more in done:
        runs = runs.unionByName(more)
    return runs.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "first", "last", "n", "label")
