"""Writers: comma-separated tables, annotation files, JSON hypnograms, partitioned Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder of comma-separated files with a header; arrays and maps as JSON."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(path)


def to_annotations(events: DataFrame, path: str, start: str, duration: str, label: str, mode: str = "error") -> None:
    """Annotation files (onset, label, duration) in order of onset within each file."""
    rows = events.select(F.col(start).alias("onset"), F.lit(label).alias("label"), F.col(duration).alias("duration"))
    rows.sortWithinPartitions("onset").write.mode(mode).option("header", True).csv(path)


def to_json(docs: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One JSON document a line."""
    docs.select(F.col(column).alias("value")).write.mode(mode).text(path)


def to_parquet(df: DataFrame, path: str, by: Sequence[str], mode: str = "error") -> None:
    """Parquet partitioned by ``by``; rows are brought together first, so a partition has few files."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)
