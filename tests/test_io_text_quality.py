"""Sinks, sources, streaming ingest, text functions and quality checks."""

import datetime as dt
import math
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekcast import schema as sc
from weekcast.functions import text as tx
from weekcast.operators import quality as qa
from weekcast.sources import files as fs
from weekcast.sources import sinks as sk


def _tmp():
    return tempfile.mkdtemp(prefix="weekcast-test-")


def test_conform_missing_and_bool(spark):
    df = spark.createDataFrame([(1, 2.0, float("nan")), (2, 0.0, 1.0)], "store_id int, x double, store_type_a double")
    schema = T.StructType([T.StructField("store_id", T.IntegerType()), T.StructField("has_markdown", T.BooleanType()),
                           T.StructField("store_type_a", T.BooleanType()), T.StructField("cpi", T.DecimalType(12, 7))])
    r = sk.conform_to_schema(df, schema).orderBy("store_id").collect()
    assert r[0].has_markdown is False and r[0].cpi is None   # missing columns
    assert r[0].store_type_a is True and r[1].store_type_a is True  # NaN -> true, 1.0 -> true


def test_append_unique_rejects(spark):
    path = os.path.join(_tmp(), "t")
    base = spark.createDataFrame([(1, 1, dt.date(2024, 1, 5))], "store_id int, dept_id int, date date")
    sk.append(base, path)
    batch = spark.createDataFrame([(1, 1, dt.date(2024, 1, 5)), (1, 1, dt.date(2024, 1, 12)),
                                   (2, 1, dt.date(2024, 1, 5)), (2, 1, dt.date(2024, 1, 5))],
                                  "store_id int, dept_id int, date date")
    sk.append_unique(batch, path, ["store_id", "dept_id", "date"], rejects=path + "-rejects")
    assert sk.scan_unique(spark, path + "-rejects").count() == 2  # existing key + the second copy of a key
    assert spark.read.parquet(path).count() == 2


def test_stores_csv_cr_line_ends(spark):
    d = _tmp()
    with open(os.path.join(d, "stores.csv"), "w", newline="") as f:
        f.write("Store,Type,Size\r1,A,151315\r2,A,202307\r3,B,37392\r")
    r = fs.scan_stores(spark, d).orderBy("store_id").collect()
    assert [x.store_type for x in r] == ["A", "A", "B"] and r[2].size == 37392


def test_features_csv_na(spark):
    d = _tmp()
    with open(os.path.join(d, "features.csv"), "w") as f:
        f.write("Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday\n")
        f.write("1,2010-02-05,42.31,2.572,NA,NA,NA,NA,NA,211.0963582,8.106,FALSE\n")
        f.write("1,2010-02-12,38.51,2.548,NA,NA,NA,NA,NA,211.2421698,8.106,NA\n")
    r = fs.scan_features(spark, d).orderBy("date").collect()
    assert r[0].markdown1 is None and r[0].is_holiday is False and str(r[0].cpi) == "211.0963582"
    assert r[1].is_holiday is True  # a missing flag converts to true, like the original loader


def test_stream_ingest(spark):
    from weekcast.streaming.ingest import ingest_sales

    base = _tmp()
    landing, table = f"{base}/landing", f"{base}/table"
    rows = [(1, 1, "2024-01-05", "10.50", "false"), (1, 2, "2024-01-05", "3.00", "true"),
            (1, 1, "2024-01-05", "99.00", "false")]  # the last repeats a key
    df = spark.createDataFrame(rows, "store_id int, dept_id int, date string, weekly_sales string, is_holiday string")
    df.coalesce(1).write.option("header", True).csv(f"{landing}/a")
    q = ingest_sales(spark, f"{landing}/*", table, f"{base}/rejects", f"{base}/ckpt")
    q.awaitTermination()
    assert spark.read.parquet(table).count() == 2  # one of the repeated key's rows stays
    assert [float(r.weekly_sales) for r in spark.read.parquet(f"{base}/rejects").collect()] == [99.0]


def test_unique_append_accounts_for_every_row(spark):
    from weekcast.sources import sinks as sk

    rows = [(1, "a", 5), (1, "a", 4), (1, "a", 4), (2, "b", 1), (None, "c", 1), (None, "c", 1), (3, "d", 9)]
    df = spark.createDataFrame(rows, "k int, t string, v int")
    old = spark.createDataFrame([(3, "x", 0), (None, "c", 0)], "k int, t string, v int")
    ok, no = sk.split_unique(df, old, ["k"])
    assert sorted(map(str, ok.collect())) == sorted(map(str, spark.createDataFrame([(1, "a", 4), (2, "b", 1), (None, "c", 1), (None, "c", 1)], df.schema).collect()))
    assert ok.count() + no.count() == len(rows)


def test_unique_append_prunes_months_and_replays(spark):
    from weekcast.sources import sinks as sk

    base = _tmp()
    table, rejects = f"{base}/t", f"{base}/r"
    df = spark.sql("SELECT int(id % 3) AS k, date_add(DATE'2024-01-01', int(id)) AS date, id AS v FROM range(120)")
    sk.append_unique(df.where("v < 60"), table, ["k", "date"], "date", rejects, "one")
    second = df.where("v >= 50").withColumn("v", F.col("v") + 1000)
    for _ in range(2):
        sk.append_unique(second, table, ["k", "date"], "date", rejects, "two")
        assert sk.scan_unique(spark, table).count() == 120 and sk.scan_unique(spark, rejects).count() == 10
    plan = spark.read.parquet(table).where("_month BETWEEN 'm2024-02' AND 'm2024-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan


def test_unique_append_reads_only_parts_that_may_hold_its_keys(spark):
    base = tempfile.mkdtemp(prefix="weekcast-bloom-")
    table, keys = f"{base}/t", ["k", "date"]
    schema = "k int, date date, v int"
    day = lambda n: dt.date(2020, 1 + n % 4, 1 + n % 27)
    batches = {name: [(base_ + n, day(n), n) for n in range(200)] for name, base_ in (("a", 0), ("b", 1000), ("c", 2000))}
    for name, rows in batches.items():
        df = spark.createDataFrame(rows, schema)
        # a first delivery, in the months of the batches before it: nothing of the table is read
        assert sk.existing_keys(df, table, keys, "date", name) is None
        sk.append_unique(df, table, keys, "date", f"{base}/r", name)
    assert sk.scan_unique(spark, table).count() == 600
    # one key of b comes again among new ones: its month of b is read, and nothing else
    again = spark.createDataFrame([(1005, day(5), 7), (9001, day(1), 1), (None, day(1), 1)], schema)
    found = sk.existing_keys(again, table, keys, "date", "d")
    assert {tuple(r) for r in found.select("_batch", "_month").collect()} == {("b", "m2020-02")}
    assert re.search(r"PartitionFilters: \[[^\]]*m2020-02", found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    sk.append_unique(again, table, keys, "date", f"{base}/r", "d")
    assert sk.scan_unique(spark, table).count() == 602
    assert [tuple(r) for r in sk.scan_unique(spark, f"{base}/r").collect()] == [(1005, day(5), 7)]
    # a batch that comes again is decided against the others only; a part of the table without a filter is read
    sk.append_unique(again, table, keys, "date", f"{base}/r", "d")
    assert sk.scan_unique(spark, table).count() == 602
    old = spark.createDataFrame([(7777, day(7), 0)], schema)
    old.withColumn("_month", F.date_format("date", "'m'yyyy-MM")).write.partitionBy("_month").parquet(f"{table}/_batch=old")
    sk.append_unique(old, table, keys, "date", f"{base}/r", "e")
    assert sk.scan_unique(spark, table).where("k = 7777").count() == 1


def test_key_filters_hold_their_keys_and_few_others(spark):
    held = spark.range(5000).selectExpr("CAST(id AS INT) AS k", "DATE '2020-01-05' AS date")
    filters = sk.key_filter(held, ["k"], "date").withColumn("_batch", F.lit("x")).cache()
    assert sk.held_parts(held.where("k % 500 = 3"), filters, ["k"], "date") == [("x", "m2020-01")]
    assert sk.held_parts(held.withColumn("date", F.lit(dt.date(2020, 2, 1))), filters, ["k"], "date") == []
    seeming = sum(bool(sk.held_parts(spark.createDataFrame([(10_000 + n, dt.date(2020, 1, 9))], "k int, date date"), filters, ["k"], "date")) for n in range(8))
    assert seeming <= 1


def test_text_functions(spark):
    df = spark.createDataFrame([("# Title\n## Sub\ncost $5\r# x",)], "t string")
    r = df.select(tx.sanitize_markdown(F.col("t")).alias("s")).collect()[0].s
    assert r == "### Title\n#### Sub\ncost \\$5\r# x"
    names = spark.createDataFrame([(n,) for n in ["sales_lag_1", "rolling_std_4", "week_of_year", "cpi_change",
                                                  "total_markdown", "store_type_a", "size_normalized", "is_holiday"]],
                                  "f string")
    cats = [x.c for x in names.select(tx.categorize_feature(F.col("f")).alias("c")).collect()]
    assert cats == ["Lag Features", "Rolling Statistics", "Temporal Features", "Economic Indicators",
                    "Markdown Features", "Store Features", "Other", "Other"]
    m = spark.range(1).select(tx.format_currency(F.lit(1234567.5)).alias("a"), tx.format_pct(F.lit(1.25)).alias("b"),
                              tx.scope_label(F.lit(None).cast("int"), F.lit(None).cast("int")).alias("c")).collect()[0]
    assert m.a == "$1,234,567.50" and m.b == "+1.2%" and m.c == "All stores and departments"


def test_percent_rounds_as_python_does(spark):
    xs = [1.25, 0.25, -0.35, 0.35, -0.25, 2.5, 0.05, -0.05, 1234.55, 0.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r.p for r in df.select(tx.format_pct(F.col("x")).alias("p")).collect()] == [f"{x:+.1f}%" for x in xs]
    assert [r.p for r in df.select(tx.format_fixed(F.col("x")).alias("p")).collect()] == [f"{x:.1f}" for x in xs]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "k int, v int")
    assert qa.duplicate_keys(df, ["k"]).collect()[0].n_rows == 2
    assert qa.null_counts(df, ["v"]).collect()[0].v_nulls == 1
    parent = spark.createDataFrame([(1,), (3,)], "k int")
    assert [r.k for r in qa.missing_children(parent, df, "k").collect()] == [3]
    assert [r.k for r in qa.fk_violations(df, parent, "k").collect()] == [2]
    inf = spark.createDataFrame([(math.inf,), (float("nan"),), (1.0,)], "x double")
    r = qa.infinite_values(inf).collect()[0]
    assert r.x_inf == 1 and r.x_nan == 1
