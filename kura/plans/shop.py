"""The catalog's own tables, laid over the driver's tables by SQL that Spark and DuckDB both read.

part gives books, nation publishers, lineitem of returned and accepted rows wishes and owned items, customer follows. Nulls,
empty strings and merged ids are put in on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

TABLES = {
    "publishers": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS code, concat('P', CAST(n_nationkey AS VARCHAR(9))) AS name FROM {nation}",
    "books": """SELECT p_partkey AS id, p_partkey % 25 AS publisher_id, p_name AS title, lower(p_name) AS normalized_title, CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 9 = 1 THEN '' ELSE p_brand END AS author,
CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE concat('978', CAST(p_partkey AS VARCHAR(20))) END AS isbn, p_type AS series_title, lower(p_type) AS series_key,
CASE WHEN p_size % 3 = 0 THEN 'novel' WHEN p_size % 3 = 1 THEN 'manga' ELSE 'unknown' END AS media_type, CASE WHEN p_size % 10 = 0 THEN 'limited' ELSE 'standard' END AS edition_type, CAST(p_size AS VARCHAR(9)) AS volume_label,
CASE WHEN p_partkey % 7 <> 0 THEN DATE '1997-12-01' + CAST(p_partkey * 37 % 400 AS INTEGER) END AS release_date, CASE WHEN p_partkey % 11 = 0 THEN 'cancelled' WHEN p_partkey % 2 = 0 THEN 'scheduled' ELSE 'available' END AS release_status,
CASE WHEN p_partkey % 5 = 0 THEN 'restricted_18' WHEN p_partkey % 5 <> 1 THEN 'general' END AS content_rating, CASE WHEN p_partkey % 6 = 0 THEN 'BL' WHEN p_partkey % 6 = 1 THEN '' END AS bl_category,
p_partkey * 13 % 1000 AS updated_at, p_partkey * 29 % 1000 AS first_seen_at FROM {part}""",
    "wishlist": """SELECT o_custkey AS user_id, l_partkey AS book_id, max(o_orderstatus) AS state, max(l_linenumber) AS priority, max(CASE WHEN l_shipdate > TIMESTAMP '1997-01-01 00:00:00' THEN l_shipdate END) AS purchased_at,
max(CASE WHEN l_quantity > 30 THEN 'paper' WHEN l_quantity > 10 THEN 'both' END) AS owned_format, max(l_orderkey) AS updated_at FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2""",
    "collection": """SELECT o_custkey * 1000000 + l_partkey AS id, o_custkey AS user_id, CASE WHEN l_partkey % 8 <> 0 THEN l_partkey END AS book_id, concat('own ', CAST(l_partkey AS VARCHAR(20))) AS title, 'me' AS author, 'manga' AS media_type, '979' AS isbn,
'standard' AS edition_type, CASE WHEN l_partkey % 3 = 0 THEN DATE '1997-05-05' END AS release_date, min(CASE WHEN l_quantity > 25 THEN 'paper' ELSE 'digital' END) AS owned_format,
max(CASE WHEN l_shipdate > TIMESTAMP '1998-01-01 00:00:00' THEN l_shipdate END) AS purchased_at FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY o_custkey, l_partkey""",
    "follows": """SELECT c_custkey AS user_id, c_custkey % 25 AS publisher_id, CASE WHEN c_custkey % 3 = 0 THEN 'economy' WHEN c_custkey % 3 = 1 THEN 'standard' ELSE 'promo' END AS normalized_series,
CASE WHEN c_custkey % 2 = 0 THEN 'novel' ELSE 'manga' END AS media_type, CASE WHEN c_custkey % 4 = 0 THEN 'all' ELSE 'future' END AS follow_scope FROM {customer}""",
    "merges": "SELECT p_partkey AS old_book_id, p_partkey - 49 AS canonical_book_id FROM {part} WHERE p_partkey % 50 = 49",
}
SOURCES = ["nation", "part", "lineitem", "orders", "customer"]


def shop(t: Callable[[str], DataFrame], name: str) -> DataFrame:
    frames = {s: t(s) for s in SOURCES if "{" + s + "}" in TABLES[name]}
    return next(iter(frames.values())).sparkSession.sql(TABLES[name], **frames)


def with_shop(sql: str, *names: str) -> str:
    """sql, which begins with SELECT or with more named tables and a comma, over the named tables."""
    tables = [f"{n} AS ({TABLES[n].format(**{s: s for s in SOURCES})})" for n in names]
    return "WITH " + ",\n".join(tables) + (" " if sql.lstrip().upper().startswith("SELECT") else ",\n") + sql
