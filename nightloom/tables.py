"""Reading the input tables and settling repeated deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: Sequence[str], version: str, columns: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one delivered last.

    Map-side combined (``max`` of a struct), so a hot key costs no large group.
    Equal versions: the greatest row by ``columns``; a null version is oldest;
    rows with a null key form one key. Columns other than those named go.
    """
    rest = [c for c in columns if c not in key]
    picked = df.groupBy(*key).agg(F.max(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in rest])).alias("_r"))
    return picked.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_code(df: DataFrame, key: Sequence[str], version: str, code: Column, name: str) -> DataFrame:
    """``(key, name)``: what :func:`latest` gives for one small whole number, as the greatest of one packed number.

    code: -7..7 or null. A plain ``max`` of numbers is hashed where that of a
    struct is sorted. version: a timestamp, to the microsecond. Equal versions:
    the greatest code; a null version is oldest, a null code smallest.
    """
    at = F.coalesce(F.unix_micros(F.col(version).cast("timestamp")), F.lit(-(1 << 58)))
    packed = df.groupBy(*key).agg(F.max(at * 16 + F.coalesce(code.cast("bigint"), F.lit(-8)) + 8).alias("_p"))
    return packed.select(*key, F.nullif(F.pmod("_p", F.lit(16)) - 8, F.lit(-8)).cast("int").alias(name))
