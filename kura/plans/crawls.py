"""Queries of pages and sheets: markup made from the driver's rows and read back, each beside its SQL over those rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kura.sources import markup, publishers

from .catalog import query


@query(r"SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]+\"')) AS n_links, html LIKE '%<title>%' AS titled FROM pages")
def page_parse(t):
    rows = t("pages").select("page_id", "html", markup.page("html").alias("p"))
    return rows.select("page_id", F.size("p.links").cast("long").alias("n_links"), F.contains("html", F.lit("<title>")).alias("titled"))


@query("SELECT p_partkey, 1 AS line, p_name AS text, p_brand AS href FROM part UNION ALL SELECT p_partkey, 2, 'see ' || p_type || ' & more', p_brand FROM part")
def page_lines(t):
    html = F.format_string("<head><meta name='Brand' content=\"%s\"><style>p{}</style></head><div> %s <script>no()</script></div><p>see <a class=x href='%s'><b>%s</b> &amp; more</a>", "p_brand", "p_name", "p_brand", "p_type")
    rows = t("part").select("p_partkey", markup.page(html).alias("p"))
    rows = rows.where(F.col("p.meta")["brand"] == F.col("p.links")[0]["href"])
    return rows.select("p_partkey", F.posexplode(F.split("p.text", "\n")).alias("pos", "text"), F.col("p.links")[0]["href"].alias("href")).select("p_partkey", (F.col("pos") + 1).alias("line"), "text", "href")


@query("SELECT p_partkey, 0 AS row, 0 AS cell, 'Name' AS text FROM part UNION ALL SELECT p_partkey, 0, 1, 'a b' FROM part UNION ALL SELECT p_partkey, 1, 0, p_name FROM part UNION ALL SELECT p_partkey, 1, 1, CAST(p_size AS VARCHAR) FROM part")
def table_cells(t):
    html = F.format_string("<table><tr><th>Name</th><TH>a<br/>b</tr><tr><td></td></tr><tr><td> %s<td>%s</td></tr></table>", "p_name", "p_size")
    html = F.replace(F.replace(html, F.lit("</TH>"), F.lit("</th>")), F.lit("b</tr>"), F.lit("b</th></tr>"))
    html = F.replace(html, F.lit("<td>"), F.lit("</td><td>"))
    rows = t("part").select("p_partkey", F.posexplode(markup.tables(html)).alias("row", "cells"))
    return rows.select("p_partkey", "row", F.posexplode("cells").alias("cell", "text"))


@query("SELECT p_partkey, n AS pos, 'https://x/' || p_partkey || '?a=' || n || '&b' AS url FROM part, (VALUES (0), (1), (2)) v(n)")
def sitemap_urls(t):
    loc = lambda n: F.concat(F.lit("<url><LOC> https://x/"), F.col("p_partkey").cast("string"), F.lit(f"?a={n}&amp;b\n</LOC></url>"))
    return t("part").select("p_partkey", F.posexplode(markup.sitemap(F.concat(*map(loc, range(3))))).alias("pos", "url"))


@query("SELECT o_orderkey, strftime(CAST('2026-' || strftime(o_orderdate, '%m-%d') AS DATE), '%Y/%m/%d') AS day, 'a, \"b\" ' || o_orderstatus AS title, 'N' || o_orderkey AS number FROM orders WHERE strftime(o_orderdate, '%m-%d') <> '02-29'")
def sheet_schedule(t):
    rows = t("orders").where(F.date_format("o_orderdate", "MM-dd") != "02-29")
    sheet = F.concat(F.lit('上市日,一,二,號\n'), F.date_format("o_orderdate", "M/d"), F.lit(',"a, ""b"" '), F.col("o_orderstatus"), F.lit('",,N'), F.col("o_orderkey").cast("string"), F.lit("\nx,y,z,w\n"))
    return rows.select("o_orderkey", F.explode(markup.schedule(sheet, 2026)).alias("r")).select("o_orderkey", F.col("r")[0].alias("day"), F.col("r")[1].alias("title"), F.col("r")[3].alias("number"))


@query("SELECT o_orderkey, o_orderkey % 3000 AS number, CAST((year(o_orderdate) + 28) * 100 + month(o_orderdate) AS INTEGER) AS month FROM orders WHERE abs((year(o_orderdate) - 1998) * 12 + month(o_orderdate) - 6) <= 2")
def schedule_tabs(t):
    roc = F.format_string("%d%02d", F.year("o_orderdate") + 28 - 1911, F.month("o_orderdate"))
    page = F.concat(F.lit('items.push({name: "'), roc, F.lit('(動漫)", pageUrl: "x", gid: "'), (F.col("o_orderkey") % 3000).cast("string"), F.lit('"});items.push({name: "'), roc, F.lit('(圖書)", gid: "9"});'))
    tabs = markup.near_months(markup.sheet_tabs(page), F.lit("2026-06-15").cast("date"))
    return t("orders").select("o_orderkey", F.explode(tabs).alias("x")).select("o_orderkey", F.col("x.gid").cast("long").alias("number"), F.col("x.month").alias("month"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%m') AS m, CASE WHEN o_orderkey % 2 = 0 THEN '小說' ELSE '漫畫' END AS kind, 'b' || o_orderkey % 40 AS title, o_orderkey % 1000 AS page FROM orders WHERE strftime(o_orderdate, '%m-%d') <> '02-29'),
d AS (SELECT kind, title, page, CASE WHEN page % 2 = 0 AND CAST(m AS INTEGER) <= 2 THEN 2031 WHEN page % 2 = 1 AND CAST(m AS INTEGER) >= 11 THEN 2029 ELSE 2030 END AS year, o_orderkey FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY kind, title ORDER BY page, year) AS n FROM d)
SELECT sha1(kind || '|' || title || '|me') AS source_key, title, CASE kind WHEN '小說' THEN 'novel' ELSE 'manga' END AS media_type, count(*) AS n_rows FROM d GROUP BY ALL""")
def article_records(t):
    kind = F.when(F.col("o_orderkey") % 2 == 0, "小說").otherwise("漫畫")
    row = F.format_string("<tr><td>%s</td><td>%s</td><td>b%d</td><td>me</td><td></td><td>1,200</td></tr>", F.date_format("o_orderdate", "M/d"), kind, F.col("o_orderkey") % 40)
    page = F.col("o_orderkey") % 1000
    rows = t("orders").where(F.date_format("o_orderdate", "MM-dd") != "02-29").select(page.alias("page_order"), row.alias("row"))
    articles = rows.groupBy("page_order").agg(F.array_join(F.array_sort(F.collect_list("row")), "").alias("rows"))  # an article's table
    articles = articles.select("page_order", F.concat(F.lit("https://x/"), F.col("page_order").cast("string")).alias("url"), F.concat(F.when(F.col("page_order") % 2 == 0, "2030-12-05").otherwise("2030/1/5"), F.lit("<table>"), F.col("rows"), F.lit("</table>")).alias("html"))
    found = publishers.records(articles, "egmanga")
    return found.groupBy("source_key", "title", "media_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""WITH s AS (SELECT p_partkey AS k, DATE '2030-01-01' + CAST(p_partkey % 50 AS INTEGER) AS d FROM part WHERE p_partkey % 3 > 0), p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 > 0 THEN DATE '2030-02-01' + CAST(p_partkey % 50 AS INTEGER) - 40 END AS d FROM part WHERE p_partkey % 5 > 0)
SELECT 'N' || coalesce(s.k, p.k) AS source_key, coalesce(p.d, s.d) AS release_date, CASE WHEN p.d IS NOT NULL THEN 'product' WHEN p.k IS NOT NULL OR s.k IS NOT NULL THEN 'unknown' END AS source FROM s FULL JOIN p ON s.k = p.k WHERE s.k IS NOT NULL OR p.d >= DATE '2030-01-11'""")
def schedule_enriched(t):
    schema = {n: "string" for n, _ in publishers.KINDS} | {"list_price": "long", "release_date": "date"}

    def books(keep, date, source):
        rows = t("part").where(keep).select(F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("source_key"), date.alias("release_date"), F.lit(source).alias("release_date_source"))
        return rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in schema.items()])

    k = (F.col("p_partkey") % 50).cast("int")
    plan = books("p_partkey % 3 > 0", F.date_add(F.lit("2030-01-01").cast("date"), k), "unknown")
    pages = books("p_partkey % 5 > 0", F.when(F.col("p_partkey") % 4 > 0, F.date_add(F.lit("2030-02-01").cast("date"), k - 40)), "product")
    return publishers.enriched(plan, pages, F.lit("2030-02-10").cast("date")).select("source_key", "release_date", F.col("release_date_source").alias("source"))
