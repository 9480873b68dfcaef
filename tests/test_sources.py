"""Readers of pages and sheets on fixtures; precedence rules on the cases that matter."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from kura.operators import filters, folds, ingest
from kura.sources import markup, publishers


def read(reader, html, url="https://www.example.org/products/K1"):
    return list(publishers.READERS[reader](url, html))


def test_markup():
    lines, links, meta = markup.parse('<!-- <p>no --><META Property="og:Title" content=\'A "b" &amp; c\'><p>one<br>two &lt;3<a href="/x?a=1&amp;b">  L <b>k</b></a><svg><p>z</svg><a>none</a><td>t')
    assert lines == "one\ntwo <3 L k" + "none\nt" and links == [("/x?a=1&b", "L k")] and meta == {"og:title": 'A "b" & c'}
    assert markup.table_rows("<table><tr><th>a<td>b</table>") == [] and markup.table_rows("<tr><td>a<br>b</td><td> </td></tr><tr><td></td></tr>") == [["a b", ""]]
    assert markup.parse("") == ("", [], {})


def test_sheets(spark):
    rows = markup.sheet_rows('上市日,動漫(新),動漫(再),尖端書碼\n10/1,"【輕小說】你好，魔女",,7B001189\n10/2,,漫畫(02),6J001751\nx,y,z,w\n', 2026)
    assert rows == [["2026/10/01", "【輕小說】你好，魔女", "", "7B001189"], ["2026/10/02", "", "漫畫(02)", "6J001751"]]
    with pytest.raises(ValueError):
        markup.sheet_rows("<html>Sign in</html>", 2026)
    df = spark.createDataFrame([('items.push({name: "11510(動漫)", pageUrl: "x", gid: "123"});items.push({name: "11510(圖書)", gid: "456"});items.push({name: "202613（動漫）", gid: "4"});', "<html>")], "m string, s string")
    row = df.select(markup.sheet_tabs(F.col("m")).alias("t"), markup.schedule(F.col("s"), 2026).alias("s"), markup.sitemap(F.lit("<urlset><loc>a</loc><LOC> b </LOC>")).alias("u")).first()
    assert [tuple(t) for t in row.t] == [(202610, "123")] and row.s is None and row.u == ["a", "b"]


def test_readers():
    day = datetime.date
    got = read("egmanga", "<p>2026-12-03</p><table><tr><td>1/5</td><td>小說</td><td>書名 3</td><td>作者</td><td>x</td><td>1,200</td></tr><tr><td>12/9</td><td>雜誌</td><td>t</td><td>a</td><td></td><td></td></tr></table>")
    assert [(r["release_date"], r["media_type"], r["list_price"], r["author"]) for r in got] == [(day(2027, 1, 5), "novel", 1200, "作者")]
    assert read("egmanga", "<p>no date</p>") == []
    got = read("tongli_planned", "<tr><td>書名／集數</td><td>a</td><td>b</td><td>c</td><td>1</td></tr><tr><td># 新書 1</td><td></td><td>輕小說系列</td><td></td><td>x</td></tr>")
    assert [(r["title"], r["media_type"], r["author"], r["list_price"], r["release_date"], r["source_key"][:8]) for r in got] == [("新書 1", "novel", None, None, None, "planned:")]
    got = read("spp_schedule", "<tr><td>2026/10/1</td><td>【輕小說】你好</td><td></td><td>A1</td></tr><tr><td>2026/10/2</td><td></td><td>再版</td><td>A2</td></tr><tr><td>2026/13/2</td><td>q</td><td></td><td>A3</td></tr>")
    assert [(r["source_key"], r["title"], r["media_type"], r["release_date"]) for r in got] == [("A1", "你好", "novel", day(2026, 10, 1)), ("A2", "再版", "manga", day(2026, 10, 2))]
    data = {"Title": "測試漫畫(1)", "Id": 7, "CategoryLevelName": {"Level1_ShopCategory_Name": "漫畫"}, "SuggestPrice": 130.0, "ImageList": [{"PicUrl": "//c/x.jpg"}], "ShortDescription": "書 號：A1 作 者：某人 譯 者：他 條 碼：978-1 234-5678 上市日：2026/9/1"}
    data["ShortDescription"] = data["ShortDescription"].replace("978-1 234-5678", "978-1234-5678")
    (r,) = read("spp_product", 'x SalePageIndexViewModel"] = ' + json.dumps(data) + ";")
    assert (r["source_key"], r["author"], r["isbn"], r["cover_url"], r["list_price"], r["release_date"], r["release_date_source"]) == ("A1", "某人", "97812345678", "https://c/x.jpg", 130, day(2026, 9, 1), "product")
    assert read("spp_product", 'SalePageIndexViewModel"] = {oops') == [] and read("spp_product", "nothing") == []
    page = "<title>書名_輕小說</title><meta property='og:title' content='書名'><p>書名</p><p>搜尋</p><h1>某書 2</h1><p>作者</p><p>甲 譯者 乙 ISBN 978-986-1 出版日期 2026-05-06 定價 NT$ 1,300</p>"
    (r,) = read("tohan_product", page, "https://www.tohan.com.tw/product.php?act=view&id=55")
    assert (r["source_key"], r["release_date"], r["list_price"], r["author"]) == ("55", day(2026, 5, 6), 1300, "甲")
    page = "<meta property='og:title' content='某書 (3)'><p>首頁 輕小說 漫畫</p><h1>某書 (3)</h1><p>作者：丙 上市日期：2026/7/8 ISBN：97898612 NT$ 260</p><p>某書 (3) 推薦</p>"
    (r,) = read("kadokawa_product", page)
    assert (r["source_key"], r["media_type"], r["release_date"], r["author"], r["isbn"], r["list_price"]) == ("K1", "manga", day(2026, 7, 8), "丙", "97898612", 260)
    page = "<meta property='og:title' content='青文 2026年 8月預定'><p>類別：漫畫 書名：甲 1 作者：乙 書系：丙 定價：1,100 首刷附錄：無電子書：〇 類別：輕小說 書名：丁 作者：戊 書系： 定價：250 首刷附錄： 電子書： 會員服務</p>"
    got = read("chingwin_article", page)
    assert [(r["title"], r["media_type"], r["list_price"], r["release_date"], r["release_precision"]) for r in got] == [("甲 1", "manga", 1100, day(2026, 8, 1), "month"), ("丁", "novel", 250, day(2026, 8, 1), "month")]
    book = {"@type": "Book", "name": "甲  1", "datePublished": "2026-08-09", "author": {"name": ["乙"]}, "isbn": "978-9", "image": "/c.jpg"}
    ld = "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in (book, {"@type": "Product", "name": "甲 1", "sku": "P9", "offers": {"price": "1,250"}}, [1]))
    (r,) = read("chingwin_catalog", ld + '<script type="application/ld+json">{bad</script>', "https://www.ching-win.com.tw/list")
    assert (r["source_key"], r["title"], r["author"], r["isbn"], r["list_price"], r["cover_url"], r["source_url"]) == ("P9", "甲 1", "乙", "9789", 1250, "https://www.ching-win.com.tw/c.jpg", "https://www.ching-win.com.tw/product-detail/P9")


def test_records_and_first_of_repeated(spark):
    row = "<table><tr><td>1/5</td><td>漫畫</td><td>t</td><td>a</td><td></td><td>9</td></tr></table>"
    pages = spark.createDataFrame([(2, "u2", "2026/1/1" + row, 1), (1, "u1", "2026/1/1" + row, 1), (3, None, None, 1)], "page_order int, url string, html string, title int")
    found = publishers.records(pages, "egmanga")
    assert found.count() == 2 and [r.source_url for r in publishers.first_records(found).collect()] == ["u1"]
    assert publishers.records(pages.where("false"), "egmanga").count() == 0


def test_ratings_and_categories(spark):
    spp = 'SalePageIndexViewModel"] = ' + json.dumps({"Id": 1, "ShortDescription": "書 號：A1 條 碼：978-1111111 等 級：限制級", "CategoryName": "耽美 漫畫"})
    url = "https://www.spp.com.tw/SalePage/Index/1"
    tohan = "<p>書</p><p>作者</p><p>甲 ISBN 9786 級別：{}</p><p>相關推薦</p><p>作者</p><p>級別：限制級</p>"
    badge = "<p class='Product-summary x'>🔞 限制級</p>"
    tongli = "<p>漫畫書籍資料</p><p>某書</p><p>原文書名：</p><p>圖書分級：普遍級</p><p>內容簡介</p><p>圖書分級：限制級</p>"
    rows = [
        ("spp", url, spp, "A1", None, "restricted_18", "耽美漫畫"), ("spp", url, spp, "A2", None, "unknown", "耽美漫畫"), ("spp", url, spp, "A1", "978-2", "unknown", "耽美漫畫"),
        ("tohan", "u", tohan.format("普"), "k", None, "general", None), ("tohan", "u", tohan.format("普 級別：普"), "k", None, "unknown", None),
        ("tohan", "u", "<meta property='og:description' content='精彩 BL 小說'>" + tohan.format("x"), "k", None, "unknown", "BL小說"), ("tohan", "u", "<meta property='og:description' content='這不是BL漫畫'>", "k", None, "unknown", None),
        ("kadokawa", "u", badge, "k", None, "restricted_18", None), ("kadokawa", "u", badge * 2, "k", None, "unknown", None),
        ("tongli", "u", tongli + "<ul class='breadcrumb'><li>BL</li><li>BL漫畫</li></ul>", "k", None, "general", "BL漫畫"), ("chingwin", "u", "<p>產品編號：Z</p><ol class=\"breadcrumb\"><li>BL</li></ol>", "k", None, "unknown", None), (None, None, None, None, None, "unknown", None),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "publisher_code string, url string, html string, source_key string, isbn string").coalesce(1)
    assert [(r.rating, r.bl_category) for r in publishers.classified(df).collect()] == [r[5:] for r in rows]


def test_rating_precedence(spark):
    at = lambda d: None if d is None else datetime.datetime(2030, 1, d)
    cases = [  # old rating, old check, locked, new rating, new check, parser, kept
        ("general", 1, False, "unknown", 2, "spp_rating_v1", False), ("general", 1, False, "unknown", 2, "other", True), ("restricted_18", 1, False, "unknown", 2, "spp_rating_v1", True),
        ("restricted_18", 1, False, "general", 2, "spp_rating_v1", False), ("restricted_18", 1, False, "general", 1, "spp_rating_v1", True), ("restricted_18", None, False, "general", 2, "spp_rating_v1", True),
        ("general", 2, False, "restricted_18", 1, "spp_rating_v1", True), ("general", 2, False, "restricted_18", None, "spp_rating_v1", True), ("general", 1, True, "restricted_18", 2, "spp_rating_v1", True), (None, None, False, "general", None, None, False),
    ]
    names = ["o_content_rating", "o_rating_checked_at", "o_rating_locked", "n_content_rating", "n_rating_checked_at", "n_rating_parser_version", "kept"]
    df = spark.createDataFrame([(a, at(b), c, d, at(e), f, g) for a, b, c, d, e, f, g in cases], ", ".join(f"{n} {k}" for n, k in zip(names, ["string", "timestamp", "boolean", "string", "timestamp", "string", "boolean"], strict=True)))
    kept = ingest.keeps_rating(lambda f: F.col(f"o_{f}"), lambda f: F.col(f"n_{f}"))
    assert df.where(kept != F.col("kept")).count() == 0


def test_search_folds_accents_and_isbns(spark):
    df = spark.createDataFrame([("Élan vital", "978-1-23"), ("ÉLAN", "978123"), (None, None)], "t string, i string").coalesce(1)
    hit = lambda q: [r[0] for r in df.select(filters.search_any_accent(q, [F.col("t")], F.col("i"))).collect()]
    assert hit("elan") == [True, True, False] and hit("ｅｌａｎ vital") == [True, False, False] and hit("978-123") == [False, True, False] and hit("") == [True] * 3
    with pytest.raises(ValueError):
        filters.publishers("a b", "", F.col("t"))


def test_limiters_keep_a_running_total(spark):
    df = spark.range(300).select(F.lit(1).alias("k"), (F.col("id") % 50).cast("double").alias("at"), F.col("id"), F.lit(1).cast("long").alias("cost"))
    out = folds.budget_window(df, ["k"], ["at", "id"], "at", "cost", 40, 10, 1)
    assert out.where("retry_after = 0").count() == 200  # 40 in each of five windows of ten seconds
