"""Settling deliveries: the packed form against the general one, and white space around spellings."""

from datetime import datetime

from pyspark.sql import functions as F

from nightloom import session, stages, tables


def test_last_code_equals_latest(spark):
    at = [None, datetime(1969, 5, 1), datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 0, 0, 1)]
    rows = [(k, at[(k * 7 + i * i) % 4], None if (k + i) % 5 == 0 else (k * 3 + i) % 15 - 7) for k in range(80) for i in range(4)]
    rows += [(None, at[2], 3), (None, at[1], 7)]
    df = spark.createDataFrame(rows, "k int, v timestamp_ntz, c int").withColumn("_p", F.lit(1))
    one = {r.k: r.c for r in tables.latest(df, ["k"], "v", ["c"]).collect()}
    two = {r.k: r.c for r in tables.last_code(df, ["k"], "v", F.col("c"), "c").collect()}
    assert one == two and two[None] == 3
    assert tables.last_code(df.limit(0), ["k"], "v", F.col("c"), "c").count() == 0


def test_blanks_around_spellings(spark):
    said = [" n2 ", "\tREM\n", " 　 ", "", None, "n 2", "\u0085w"]
    df = spark.createDataFrame([(x,) for x in said], "s string")
    old = F.nullif(F.upper(F.regexp_replace("s", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))
    got = df.select(stages.tidy(F.col("s")).alias("a"), old.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == ["N2", "REM", None, None, None, "N 2", "\u0085W"]
    assert sorted(stages.BLANKS) == sorted(chr(p) for p in range(0x3001) if chr(p) in "\t\n\x0b\f\r" or __import__("unicodedata").category(chr(p)) in ("Zs", "Zl", "Zp"))


def test_bounded_counts_rows(spark):
    df = session.cut(spark.range(50).withColumnRenamed("id", "k"))
    big = spark.range(1000).withColumn("k", F.col("id") % 60)
    plan = lambda small: big.join(small, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(session.bounded(df)) and "strategy=merge" in plan(session.bounded(df, 49))
    assert big.join(session.bounded(df, 49), "k").count() == big.join(session.bounded(df), "k").count()
