"""Fields of raw pages by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, pos, href of each anchor."""
    found = F.regexp_extract_all(html_col, F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("pos", "href"))


def url_parts(url: Column) -> list[Column]:
    part = lambda p, *k: F.try_parse_url(url, F.lit(p), *k)
    return [F.lower(part("HOST")).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query")]
