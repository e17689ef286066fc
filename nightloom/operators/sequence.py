"""Ordered sequences cut into slices, so that one hot key needs no single task.

A key's rows are grouped by ``(key, slice)``; what crosses a slice's edge is
settled afterwards from a few rows a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, slice_of: Column) -> DataFrame:
    """``df`` plus ``run_length``: rows in the run of equal successive ``value`` that a row belongs to.

    keys: the sequence a row belongs to; order: its place there (ties are in no
    defined order, so name enough columns); slice_of: a value that never falls
    along ``order`` (for instance time divided by a width) and bounds the rows
    of one ``(keys, slice)``. Nulls in ``value`` are a value of their own. An
    empty table gives an empty one. The work columns ``_slice _run _len _edge``
    replace columns of these names.
    """
    part = [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy(*order)
    whole = Window.partitionBy(*part)
    rows = df.withColumn("_slice", slice_of)
    rows = rows.withColumn("_run", F.sum(F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w))
    rows = rows.withColumns({"_len": F.count(F.lit(1)).over(Window.partitionBy(*part, "_run")), "_last": F.max("_run").over(whole)})
    edges = rows.where((F.col("_run") == 1) | (F.col("_run") == F.col("_last"))).groupBy(*part, "_run").agg(F.first(value).alias("_v"), F.max("_len").alias("_len"), F.max("_last").alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_slice", "_run")
    joined = F.lag("_v").over(along).eqNullSafe(F.col("_v")) & (F.lag("_slice").over(along) < F.col("_slice")) & (F.col("_run") == 1)
    edges = edges.withColumn("_isle", F.sum(F.when(joined, 0).otherwise(1)).over(along))
    edges = edges.select(*part, "_run", F.sum("_len").over(Window.partitionBy(*keys, "_isle")).alias("_edge"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*part, "_run")]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    out = rows.alias("a").join(edges.alias("b"), condition, "left")
    kept = [c for c in rows.columns if c not in ("_slice", "_run", "_len", "_last", "run_length")]
    return out.select(*[F.col(f"a.{c}") for c in kept], F.coalesce("_edge", "_len").alias("run_length"))


def changes(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Where a row's key differs from the row before; nulls are equal to each other."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for name in names:
        col = batch.column(name)
        a, b = col.slice(0, n - 1), col.slice(1)
        differs = pc.fill_null(pc.not_equal(a, b), False)
        nulls = pc.not_equal(pc.is_null(a), pc.is_null(b))
        new[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], work: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work(rows, number of each row's group from 0)`` over batches of whole groups; rows must come grouped.

    The last group of a batch waits for the next one.
    """
    rest: list[pa.RecordBatch] = []
    at = lambda batch, i: [batch.column(name)[i].as_py() for name in names]

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if len(rest) > 1 and at(rest[0], 0) == at(batch, batch.num_rows - 1):
            continue  # still one group
        whole = joined()
        new = changes(whole, names)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield from work(whole.slice(0, last), np.cumsum(new[:last]) - 1)
        rest = [whole.slice(last)]
    if rest:
        whole = joined()
        yield from work(whole, np.cumsum(changes(whole, names)) - 1)
