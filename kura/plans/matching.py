"""Queries of titles, product addresses, pairing, imports, uploads and sequential rules, each beside its SQL.

Roles as in catalog. The sequential rules have no SQL; tests hold them against a plain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from kura.functions import titles
from kura.operators import folds, identity

from .catalog import query


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN CAST(p_size AS VARCHAR) END AS volume, CASE WHEN p_partkey % 4 = 3 THEN upper(p_name) ELSE p_name END AS inferred,
CASE WHEN p_name = 'small ring' AND p_brand = 'Brand#2' THEN 'SMALL RING~' WHEN p_name = 'red widget' THEN 'Crimson' WHEN p_partkey % 4 = 3 THEN upper(p_name) ELSE p_name END AS series_title,
CASE WHEN p_name = 'red widget' THEN 'crimson' ELSE replace(p_name, ' ', '') END AS series_key FROM part""")
def series_titles(t):
    name, size, kind = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit("【預購】"), name, F.lit(" 第"), size, F.lit("集 首刷限定版"))).when(kind == 1, F.concat(name, F.lit("（"), size, F.lit("）")))
    raw = raw.when(kind == 2, F.concat(name, F.lit(" Vol."), size)).otherwise(F.upper(name))
    part = t("part").withColumn("raw", raw)
    aliases = part.sparkSession.createDataFrame([("Brand#2", "small ring", "SMALL RING~"), ("*", "red widget", "Crimson")], "scope string, alias string, canonical string")
    return titles.series_keys(part, "raw", "p_brand", aliases).select("p_partkey", titles.extract_volume(F.col("raw")).alias("volume"), titles.infer_series_title(F.col("raw")).alias("inferred"), "series_title", "series_key")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'https://www.tohan.com.tw/product.php?act=view&id=' || p_partkey WHEN 1 THEN 'https://www.ching-win.com.tw/product-detail/P' || p_partkey WHEN 2 THEN 'https://www.kadokawa.com.tw/products/' || p_partkey
WHEN 3 THEN 'https://www.tongli.com.tw/BooksDetail.aspx?Bd=' || p_partkey ELSE CASE WHEN p_size <= 25 THEN 'https://www.spp.com.tw/SalePage/Index/' || p_partkey END END AS address FROM part""")
def product_addresses(t):
    id_, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    forms = [("tohan", "http://www.tohan.com.tw/product.php?x=1&act=view&id=", ""), ("chingwin", "https://www.ching-win.com.tw/product-detail/P", "/"), ("kadokawa", "https://kadokawa.com.tw/products/", "#x"), ("tongli", "https://www.tongli.com.tw/booksdetail.aspx?bd=", "")]
    code, url = F.lit("spp"), F.concat(F.when(F.col("p_size") <= 25, "https://www.spp.com.tw").otherwise("https://example.org"), F.lit("/v2/official/SalePage/Index/"), id_, F.lit("?a=b"))
    for i, (name, head, tail) in enumerate(forms):
        code, url = F.when(kind == i, name).otherwise(code), F.when(kind == i, F.concat(F.lit(head), id_, F.lit(tail))).otherwise(url)
    return t("part").select("p_partkey", titles.product_address(code, url).alias("address"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'guidance_15' WHEN 2 THEN 'restricted_18' WHEN 3 THEN 'restricted_18' ELSE 'unknown' END AS rating FROM part")
def rating_labels(t):
    label = F.element_at(F.array(*[F.lit(x) for x in ("普遍級", "輔 15 級", "Ｒ-18", "本書為限制級", "x", None)]), (F.col("p_size") % 6 + 1).cast("int"))
    return t("part").select("p_partkey", titles.rating(label).alias("rating"))


@query("""WITH i AS (SELECT *, p_partkey % 4 = 0 AS planned FROM part WHERE p_partkey % 2 = 0), c AS (SELECT *, p_partkey % 3 = 0 AS planned FROM part WHERE p_partkey % 2 = 1)
SELECT i.p_partkey, CASE WHEN count(c.p_partkey) = 1 THEN min(c.p_partkey) ELSE -1 END AS matched_id FROM i LEFT JOIN c ON i.planned <> c.planned AND i.p_brand = c.p_brand AND i.p_type = c.p_type AND (i.p_name = c.p_name OR i.p_size = c.p_size) GROUP BY 1""")
def planned_pairs(t):
    incoming = t("part").where("p_partkey % 2 = 0").withColumn("planned", F.col("p_partkey") % 4 == 0)
    known = t("part").where("p_partkey % 2 = 1").withColumn("planned", F.col("p_partkey") % 3 == 0)
    return identity.pair_planned(incoming, known, "p_partkey", "planned", [["p_brand", "p_type", "p_name"], ["p_brand", "p_type", "p_size"]]).select("p_partkey", F.coalesce("matched_id", F.lit(-1)).alias("matched_id"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'new person' ELSE replace(p_name, ' ', '、') END AS author FROM part")
def author_merge(t):
    old = F.replace(F.col("p_name"), F.lit(" "), F.lit("、"))
    new = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("作者："), F.upper(F.split("p_name", " ")[1]))).when(F.col("p_size") % 3 == 2, "new person")
    return t("part").select("p_partkey", identity.richer_authors(new, old).alias("author"))


@query("""WITH r AS (SELECT o_custkey AS user_id, l_returnflag AS section, l_partkey AS book_id, l_orderkey * 10 + l_linenumber AS position, o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
m(old_id, new_id) AS (VALUES (3, 1), (5, 2)), c AS (SELECT r.*, coalesce(new_id, book_id) AS canonical_id FROM r LEFT JOIN m ON old_id = book_id WHERE o_orderstatus <> 'F'),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, section, canonical_id ORDER BY position) AS k FROM c)
SELECT user_id, section, position, canonical_id, CASE WHEN canonical_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) THEN 'missing' WHEN k > 1 OR (user_id, section, canonical_id) IN (SELECT user_id, section, book_id FROM r WHERE o_orderstatus = 'F') THEN 'existing' ELSE 'new' END AS state FROM n""")
def import_states(t):
    all_ = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_returnflag").alias("section"), F.col("l_partkey").alias("book_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), "o_orderstatus")
    valid = t("part").where("p_size < 40").select(F.col("p_partkey").alias("book_id"))
    merges = valid.sparkSession.createDataFrame([(3, 1), (5, 2)], "old_id long, new_id long")
    plan = identity.import_plan(all_.where("o_orderstatus <> 'F'"), all_.where("o_orderstatus = 'F'"), valid, merges)
    return plan.select("user_id", "section", "position", "canonical_id", "state")


@query("""WITH e AS (SELECT p_partkey // 20 AS batch, p_partkey % 11 = 0 OR p_partkey % 40 = 27 OR p_partkey % 60 IN (33, 34) AS wrong FROM part)
SELECT batch, count(*) AS n_items, CAST(count(*) FILTER (WHERE wrong) AS BIGINT) AS n_errors, count(*) FILTER (WHERE wrong) = 0 AS accepted FROM e GROUP BY 1""")
def upload_gate(t):
    id_ = F.col("p_partkey")
    rows = t("part").select(
        F.floor(id_ / 20).alias("batch"), F.col("p_brand").alias("publisher_code"), id_.cast("string").alias("source_key"), F.when(id_ % 11 != 0, F.col("p_name")).alias("title"),
        F.when(id_ % 40 == 27, "ftp://a/b").otherwise("https://example.org/x").alias("source_url"), F.lit(" Novel ").alias("media_type"), F.when(id_ % 60 == 33, "99999999").otherwise("250").alias("list_price"),
        F.when(id_ % 60 == 34, "2030-02-31").otherwise("2030-02-28").alias("release_date"), F.lit(None).cast("string").alias("rating_confidence"),
    )
    return identity.batches_without_errors(identity.checked(rows))


def _timed(t):
    return t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(None)
def rate_limit(t):
    return folds.sliding_window(_timed(t), ["user_id"], ["at", "event_id"], "at", 3, 86400).select("event_id", "retry_after")


@query(None)
def read_budget(t):
    rows = _timed(t).withColumn("cost", (F.col("event_id") % 3 + 1).cast("long"))
    return folds.budget_window(rows, ["user_id"], ["at", "event_id"], "at", "cost", 6, 86400, 3600).select("event_id", "retry_after")


@query(None)
def load_shedding(t):
    rows = _timed(t).withColumn("bad", F.col("value") > 30)
    return folds.circuit_breaker(rows, ["user_id"], ["at", "event_id"], "at", "bad", 3, 86400, 43200).select("event_id", "shed")


@query(None)
def message_packing(t):
    rows = t("events").withColumn("line", F.concat_ws(" ", "event_type", "props", F.repeat(F.lit("x"), (F.col("event_id") % 400).cast("int"))))
    return folds.message_batches(rows, ["user_id"], ["event_id"], "line", 20).select("event_id", "user_id", "batch")
