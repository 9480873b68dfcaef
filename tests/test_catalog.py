"""Every catalog query against its SQL, and rules that the driver's tables don't reach."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from kura.functions import text
from kura.operators import filters, series, tables
from kura.plans import catalog, crawls, matching, reads, writes  # noqa: F401 - add queries to catalog

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
    return sorted(map(tuple, frame.to_numpy().tolist()))


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages labels".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalog.ORACLES[name]).df())


BOOKS = [(1, "general", None), (2, "general", "BL漫畫"), (3, "restricted_18", ""), (4, "restricted_18", "BL小說"), (5, "unknown", None), (6, None, "BL小說"), (7, "guidance_15", ""), (8, "guidance_15", "BL")]


@pytest.mark.parametrize(("mode", "ids"), [("general", {1, 5, 7}), ("bl", {1, 2, 5, 6, 7, 8}), ("r18", {1, 3, 5, 7}), ("all", set(range(1, 9)))])
def test_modes(spark, mode, ids):
    df = spark.createDataFrame(BOOKS, "id int, rating string, bl string")
    assert {r.id for r in df.where(filters.visible(mode, F.col("rating"), F.col("bl"))).collect()} == ids


@pytest.mark.parametrize(("chosen", "ids"), [("", set(range(1, 9))), ("general", {1, 5, 7}), ("bl", {2, 4, 6, 8}), ("r18", {3, 4}), ("bl_r18", {4}), ("bl,r18", {2, 3, 4, 6, 8}), ("general,bl", {1, 2, 4, 5, 6, 7, 8}), ("none", set())])
def test_content(spark, chosen, ids):
    df = spark.createDataFrame(BOOKS, "id int, rating string, bl string")
    assert {r.id for r in df.where(filters.content(chosen, F.col("rating"), F.col("bl"))).collect()} == ids


def test_history_and_merge(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "k int, t string, s string")
    new = spark.createDataFrame([(1, "a", "y"), (3, "c", "z")], "k int, t string, s string")
    assert [tuple(r) for r in tables.history(old, new, "k", ["t", "s"]).collect()] == [(1, "s", None, "y")]
    done = tables.merge(old, new, "k", {c: tables.filled(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in ("t", "s")})
    assert {(r.k, r.action) for r in done.collect()} == {(1, "updated"), (2, "kept"), (3, "inserted")}


def test_gaps_without_numbers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", None)], "s string, v int")
    assert sorted(r.missing_volume for r in series.gaps(df, ["s"], "v").collect()) == [2, 3]


def test_text(spark):
    df = spark.createDataFrame([("Ａ　b", "978-0-306-40615-7"), (None, None), ("ß", "0306406153")], "t string, i string")
    got = df.select(text.normalize_text("t"), text.fold_key("t"), text.isbn_valid(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [("A b", "a b", True), (None, None, False), ("ß", "ss", False)]


def test_feed_stream(spark, tmp_path):
    from kura.streaming.feed import run

    log, names = spark.range(20).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id")), spark.createDataFrame([(0, "a"), (1, "b")], "user_id long, name string")
    log.write.parquet(f"{tmp_path}/log")
    run(spark, f"{tmp_path}/log", names, f"{tmp_path}/out", f"{tmp_path}/check")
    run(spark, f"{tmp_path}/log", names, f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows(spark.read.parquet(f"{tmp_path}/out").toPandas()) == rows(log.join(names, "user_id", "left").toPandas())
