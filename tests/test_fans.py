"""Fan-outs, duplicate plans and lists of one author do not make, or deal out, pairs beyond what they return."""

import duckdb
import pytest
from pyspark.sql import functions as F

from kura.operators import ingest, shelf
from kura.plans import catalog, reads, writes  # noqa: F401 - reads and writes add their queries to catalog


def work(df):
    """Result, the most rows that a join made and the rows that all exchanges dealt out."""
    rows, joined, dealt = df.collect(), [0], []

    def walk(node):
        kind, metrics = node.getClass().getSimpleName(), node.metrics()
        if "Join" in kind and metrics.contains("numOutputRows"):
            joined.append(metrics.apply("numOutputRows").value())
        if kind == "ShuffleExchangeExec":
            dealt.append(metrics.apply("shuffleRecordsWritten").value())
        if kind == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif "QueryStageExec" in kind:
            walk(node.plan())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sorted(map(tuple, rows)), max(joined), sum(dealt)


def test_many_rows_of_one_isbn(spark):
    kind = "id long, publisher_id long, media_type string, title string, author string, edition_type string, volume_label string, isbn string, source_key string, source_url string"
    page = "https://www.ching-win.com.tw/"
    own = [(i, 1, "novel", f"t{i}", "a", None, "1", "9780306406157", f"P{i}", f"{page}product-detail/P{i}") for i in range(60)]
    old = [(100 + i, 1, "novel", f"u{i}", "a", None, "1", "978-0-306-40615-7", f"s{i}", f"{page}about-news-detail/{i}") for i in range(60)]
    sole = [(300, 2, "novel", "x", "b、c", None, "1", None, "P300", f"{page}product-detail/P300"), (301, 2, "novel", "x", "c", None, "1", "9780306406157", "s", f"{page}about-news-detail/9"), (302, 2, "novel", "y", "z", None, "9", None, "s2", f"{page}product-detail/P300")]
    got, joined, _ = work(ingest.duplicates(spark.createDataFrame(own + old + sole, kind)).select("old_id", "canonical_id"))
    assert got == [(100 + i, None) for i in range(60)] + [(301, 300)]
    assert joined < 1000  # one for each two rows would be 3,600


def test_lists_of_an_author(spark, tmp_path):
    part = spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), (F.col("id") % 2).cast("string").alias("p_brand"), F.when(F.col("id") % 3 > 0, "t").alias("p_type"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    rows = [(r.p_partkey, r.p_brand, r.p_type) for r in part.collect()]
    ids = sorted(rows, reverse=True)
    expected = sorted((a, b) for a, brand, kind in rows for b in [b for b, x, y in ids if (x, y) != (brand, kind)][: catalog.PER_SEED])
    got, joined, _ = work(catalog.QUERIES["recs_same_author"](spark, str(tmp_path)))
    assert got == expected
    assert joined < 5000  # before, 32 of each series for each seed: 192,000


def test_follows(spark):
    books = spark.range(300).select("id", F.lit(1).alias("publisher_id"), F.lit("k").alias("series_key"), F.lit("novel").alias("media_type"), F.when(F.col("id") % 2 == 0, "scheduled").when(F.col("id") % 3 == 0, "cancelled").otherwise("available").alias("release_status"))
    twice = books.where("id < 10").withColumn("series_key", F.lit("other"))
    kind = "user_id long, publisher_id int, normalized_series string, media_type string, follow_scope string"
    follows = [(u, 1, "k", "novel", "future" if u % 2 else "all") for u in range(100)] + [(1, 1, "k", "novel", None), (2, 1, "other", "novel", "all"), (None, 1, "k", "novel", "future")]
    held = spark.createDataFrame([(0, 4), (1, 5), (1, None), (None, 6)], "user_id long, book_id long")
    df = ingest.follow_wishes(spark.createDataFrame(follows, kind), books.union(twice), held, held)
    wide = {u for u, *_, scope in follows if scope != "future"}
    taken = [(u, b) for u in [*range(100), None] for b in range(300) if (b % 2 == 0 or (b % 3 and u in wide)) and (u, b) not in [(0, 4), (1, 5)]]
    rows = df.collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, taken))
    _, _, dealt = work(ingest.follow_wishes(spark.createDataFrame(follows, kind), books, held, held).where("user_id is not null"))
    assert dealt < 12000 < len(rows)  # each pair was dealt out


@pytest.fixture(scope="module")
def few_orders(spark, tmp_path_factory):
    """Many books and users, few orders."""
    top, c = str(tmp_path_factory.mktemp("shop")), F.col
    tables = {
        "part": spark.range(500).select(c("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.concat(F.lit("Brand#"), (c("id") % 4).cast("string")).alias("p_brand"), F.lit("STANDARD").alias("p_type"), F.lit(1).alias("p_size")),
        "customer": spark.range(1, 12000, 3).select(c("id").alias("c_custkey")),
        "orders": spark.range(2000).select(c("id").alias("o_orderkey"), c("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus")),
        "lineitem": spark.range(300).select((c("id") % 100).alias("l_orderkey"), (c("id") * 7).alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(9.0).alias("l_quantity"), F.lit("R").alias("l_returnflag"), F.lit("1997-01-01").cast("timestamp_ntz").alias("l_shipdate")),
        "nation": spark.range(1).select(c("id").alias("n_nationkey")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.mark.parametrize("name", ["follow_fanout", "milestone_events"])
def test_pairs_are_not_dealt(spark, few_orders, name):
    con = duckdb.connect()
    for t in "part customer orders lineitem nation".split():
        con.sql(f"create view {t} as select * from '{few_orders}/{t}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        df = catalog.QUERIES[name](spark, few_orders)
        got, _, dealt = work(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    columns = ", ".join(df.columns)
    assert got == sorted(con.execute(f"select {columns} from ({catalog.ORACLES[name]})").fetchall())
    assert dealt < len(got)


def test_pairs_are_small_in_files(spark, tmp_path):
    fans = spark.range(400).select(F.col("id").alias("user_id"), F.lit("k").alias("key"), F.when(F.col("id") % 3 > 0, F.array(F.col("id"), F.lit(20000))).alias("held"))
    fans = fans.union(spark.createDataFrame([(None, "k", [7]), (900, "other", None), (901, None, None)], "user_id long, key string, held array<long>"))
    books = spark.range(24000).select(F.col("id").alias("book_id"), F.lit("k").alias("key")).union(spark.createDataFrame([(None, "k"), (None, "k"), (5, "k"), (6, None)], "book_id long, key string"))
    ingest.fanned(fans, books, ["key"]).write.parquet(f"{tmp_path}/pairs")
    expected = fans.join(books, "key").where(~F.coalesce(F.array_contains("held", F.col("book_id")), F.lit(False)))
    same = [F.count(F.lit(1)), F.sum(F.xxhash64("user_id", "book_id").cast("decimal(20)")), F.sum(F.col("book_id").isNull().cast("int"))]
    rows, *rest = expected.agg(*same).first()
    assert (rows, *rest) == tuple(spark.read.parquet(f"{tmp_path}/pairs").agg(*same).first())
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < rows // 2  # bytes


def test_owned_rows_are_dealt_twice(spark, tmp_path):
    c, con = F.col, duckdb.connect()
    tables = {
        "part": spark.range(100).select(c("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (c("id") % 30).cast("string")).alias("p_brand")),
        "orders": spark.range(300).select(c("id").alias("o_orderkey"), F.when(c("id") % 10 > 0, c("id") % 40).alias("o_custkey")),
        "lineitem": spark.range(9000).select((c("id") % 310).alias("l_orderkey"), F.when(c("id") % 7 > 0, c("id") % 103).alias("l_partkey")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        got, _, dealt = work(catalog.QUERIES["follow_fanout"](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(con.execute(catalog.ORACLES["follow_fanout"]).fetchall())
    assert dealt < 2 * 9000 + 2000


@pytest.fixture(scope="module")
def long_series(spark, tmp_path_factory):
    """Few series of many books; users who hold some."""
    top, c = str(tmp_path_factory.mktemp("series")), F.col
    tables = {
        "part": spark.range(6000).select(c("id").alias("p_partkey"), F.concat(F.lit("n"), c("id") % 7).alias("p_name"), F.when(c("id") % 50 > 0, F.concat(F.lit("Brand#"), c("id") % 3)).alias("p_brand"), F.lit("STANDARD").alias("p_type"), (c("id") % 2 * 3 + 1).cast("int").alias("p_size")),
        "customer": spark.range(1, 3600, 3).select(c("id").alias("c_custkey")),
        "orders": spark.range(900).select(c("id").alias("o_orderkey"), (c("id") % 31).alias("o_custkey"), F.lit("F").alias("o_orderstatus")),
        "lineitem": spark.range(900).select(c("id").alias("l_orderkey"), (5999 - c("id") * 7).alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(9.0).alias("l_quantity"), F.when(c("id") % 3 > 0, "A").otherwise("R").alias("l_returnflag"), F.lit("1997-01-01").cast("timestamp_ntz").alias("l_shipdate")),
        "nation": spark.range(1).select(c("id").alias("n_nationkey")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return top


@pytest.mark.parametrize("entries", [1 << 21, 500])
@pytest.mark.parametrize("name", ["recs_same_series", "recs_ranked"])
def test_rows_of_series_are_not_made(spark, long_series, name, entries, monkeypatch):
    monkeypatch.setattr(shelf, "ENTRIES", entries)
    con = duckdb.connect()
    for t in "part customer orders lineitem nation".split():
        con.sql(f"create view {t} as select * from '{long_series}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, long_series)
    got, joined, _ = work(df)
    assert got == sorted(con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall())
    assert joined < 12000  # with a row for each user and book of their series 21,000 and more
