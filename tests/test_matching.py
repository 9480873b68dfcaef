"""Titles, pairing and sequential rules on rows made for them; their SQL is run by test_catalog."""

import random

from pyspark.sql import functions as F

from kura.functions import titles
from kura.operators import folds, identity


def test_titles(spark):
    raw = ["【預購】某作品 第3集 首刷限定版", "某作品（上）", "ONE PIECE~航海王~ (105)", "A &amp;amp; B 12完", "", None, "作品12", "作品 1+2", "【官網限定特典】作品(4)特裝版"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").coalesce(1)
    got = df.select("i", titles.extract_volume(F.col("t")).alias("v"), titles.infer_series_title(F.col("t")).alias("s"), titles.clean_series_title(F.col("t")).alias("c"), titles.signature(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.v for r in got] == ["3", "上", "105", "12", None, None, "12", None, "4"]
    assert [r.s for r in got] == ["某作品", "某作品", "ONE PIECE~航海王", "A &amp;amp; B", "", None, "作品", "作品 1+2", "【官網限定特典】作品"]
    assert [r.c for r in got] == ["某作品", "某作品", "ONE PIECE~航海王", "A & B", "", None, "作品12", "作品", "作品"]
    assert got[2].k == "onepiece航海王105"


def test_aliases(spark):
    aliases = spark.createDataFrame([("tongli", "航海王", "ONE PIECE～航海王～"), ("*", "x", "Every"), ("a", "x", "Own")], "scope string, alias string, canonical string")
    df = spark.createDataFrame([("tongli", "ONE PIECE 航海王 3"), ("tongli", "航海王(4)"), ("b", "航海王"), ("a", "X"), ("b", "X"), (None, "X"), ("a", None)], "p string, t string")
    got = {(r.p, r.t): (r.series_title, r.series_key) for r in titles.series_keys(df, "t", "p", aliases).collect()}
    assert got == {("tongli", "ONE PIECE 航海王 3"): ("ONE PIECE～航海王～", "onepiece航海王"), ("tongli", "航海王(4)"): ("ONE PIECE～航海王～", "onepiece航海王"), ("b", "航海王"): ("航海王", "航海王"), ("a", "X"): ("Own", "own"), ("b", "X"): ("Every", "every"), (None, "X"): ("Every", "every"), ("a", None): (None, None)}


def test_addresses(spark):
    bad = [("spp", "https://www.spp.com.tw:8080/SalePage/Index/1"), ("spp", "https://u@www.spp.com.tw/SalePage/Index/1"), ("spp", "https://www.spp.com.tw/SalePage/Index/a"), ("tohan", "https://www.tohan.com.tw/product.php?id=1"), ("other", "https://x"), (None, None), ("spp", "http://[")]
    df = spark.createDataFrame([("spp", "http://www.spp.com.tw/salepage/index/12/"), *bad], "c string, u string").coalesce(1)
    assert [r[0] for r in df.select(titles.product_address("c", "u")).collect()] == ["https://www.spp.com.tw/SalePage/Index/12"] + [None] * len(bad)


def test_sole_match_and_gate(spark):
    catalog = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", None)], "id int, t string, s string")
    incoming = spark.createDataFrame([(10, "a", None), (11, "a", "s"), (12, "z", "z"), (13, None, None)], "n int, t string, s string")
    got = {r.n: r.matched_id for r in identity.sole_match(incoming, catalog, "id", [["t"], ["s"]]).collect()}
    assert got == {10: 1, 11: None, 12: None, 13: None}
    base = {"publisher_code": "a", "source_key": "k", "title": "t", "source_url": "https://a/b", "media_type": "manga", "list_price": "1", "release_date": "2030-01-01", "rating_confidence": "5"}
    cases = [({}, None), ({"title": " "}, "title is required"), ({"media_type": "dvd"}, "Invalid media_type"), ({"media_type": "mixed"}, "Invalid media_type"), ({"media_type": ""}, "Invalid media_type"), ({"media_type": "", "source_url": ""}, "Invalid media_type"), ({"title": "t" * 501}, None), ({"source_url": "https:///x"}, "source_url must be an http(s) URL"), ({"list_price": "1.5"}, "list_price must be an integer"), ({"list_price": "9" * 60}, "list_price is outside the accepted range"), ({"release_date": "2030-13-01"}, "release_date must use YYYY-MM-DD"), ({"rating_confidence": "x"}, "rating_confidence must be an integer")]
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], ", ".join(f"{k} string" for k in base)).coalesce(1)
    assert [r.error for r in identity.checked(rows).collect()] == [e for _, e in cases]
    assert [tuple(r) for r in identity.batches_without_errors(identity.checked(rows).withColumn("batch", F.lit(1))).collect()] == [(1, 12, 10, False)]


def test_choices_and_lengths(spark):
    base = {"publisher_code": "a", "source_key": "k", "title": "Ｔ " + "t" * 600, "source_url": "https://a/b", "media_type": "Novel", "list_price": "", "release_date": None, "rating_confidence": None, "release_status": "", "rating_source": "publisher"}
    rows = [base, base | {"release_status": "gone"}, base | {"rating_source": "hearsay", "release_status": "SCHEDULED "}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} string" for k in base)).coalesce(1)
    assert [r.error for r in identity.checked(df).collect()] == [None, "Invalid release_status", "Invalid rating_source"]
    assert identity.fitted(df).first().title == "T " + "t" * 498


def test_folds(spark):
    rng = random.Random(5)
    rows, now = [], 0.0
    for i in range(400):
        now += rng.choice([0, 0.5, 3, 20])
        rows.append((i, "ab"[i % 2], now, rng.randint(1, 4), rng.random() < 0.5, "x" * rng.randint(0, 700)))
    df = spark.createDataFrame(rows, "i int, k string, at double, cost long, bad boolean, line string").repartition(5)
    limited = {r.i: r.retry_after for r in folds.sliding_window(df, ["k"], ["at", "i"], "at", 3, 10).collect()}
    budget = {r.i: r.retry_after for r in folds.budget_window(df, ["k"], ["at", "i"], "at", "cost", 9, 10, 1).collect()}
    shed = {r.i: r.shed for r in folds.circuit_breaker(df, ["k"], ["at", "i"], "at", "bad").collect()}
    batch = {r.i: r.batch for r in folds.message_batches(df, ["k"], ["i"], "line", 20).collect()}
    for key in "ab":
        own, admitted, bought, bad, until, packs = [r for r in rows if r[1] == key], [], [], [], -1, [[]]
        for i, _, at, cost, is_bad, line in own:
            live = [t for t in admitted if t > at - 10]
            assert (limited[i] == 0) == (len(live) < 3)
            admitted += [at] * (len(live) < 3)
            last = {}  # a bucket lives as long as its latest row
            for t, c in bought:
                last[int(t)] = (t, c + last.get(int(t), (0, 0))[1])
            fits = sum(c for t, c in last.values() if t > at - 10) + cost <= 9
            assert (budget[i] == 0) == fits and (fits or 1 <= budget[i] <= 10)
            bought += [(at, cost)] * fits
            assert shed[i] == (at < until)
            if at >= until and is_bad:
                bad = [t for t in bad if t > at - 30] + [at]
                if len(bad) == 3:
                    bad, until = [], at + 10
            if packs[-1] and (len(packs[-1]) == 10 or 20 + sum(map(len, packs[-1])) + 3 * len(packs[-1]) + len(line) + 3 > 1900):
                packs.append([])
            packs[-1].append(line)
            assert batch[i] == len(packs) - 1
    assert folds.sliding_window(df.where("false"), ["k"], ["at"], "at").count() == 0
