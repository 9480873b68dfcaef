"""Text functions over Columns; NFKC and case folding, which Spark lacks, by an Arrow function."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """NFKC, white space collapsed; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


@F.pandas_udf(T.StringType())
def fold_key(text: pd.Series) -> pd.Series:
    """normalize_text and full case folding, for keys that are joined on."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold())


def first_marker(text: Column, markers: list[tuple[str, str]], default: str) -> Column:
    """The kind of the first marker, in their order, that the text contains."""
    out = F.lit(default)
    for marker, kind in reversed(markers):
        out = F.when(F.contains(text, F.lit(marker)), kind).otherwise(out)
    return out


def isbn_valid(isbn: Column) -> Column:
    """Check digit of an ISBN-13 or ISBN-10; hyphens and spaces don't count; null and other lengths are false."""
    s = F.upper(F.regexp_replace(F.coalesce(isbn, F.lit("")), "[- ]", ""))
    digit = lambda i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.try_to_number(F.substring(s, i, 1), F.lit("9")).cast("int"))
    thirteen = sum(((digit(i) * (3 if i % 2 == 0 else 1)) for i in range(1, 14)), F.lit(0))
    ten = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0))
    return F.when(s.rlike("^[0-9]{13}$"), thirteen % 10 == 0).when(s.rlike("^[0-9]{9}[0-9X]$"), ten % 11 == 0).otherwise(False)


def csv_safe(text: Column) -> Column:
    """A leading quote where a spreadsheet would read a formula."""
    return F.when(F.ltrim(text).rlike("^[=+\\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def ics_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in (";", ","):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def lead_days(text: Column, default: list[int]) -> Column:
    """Distinct day counts of a comma list within 0 to 90, greatest first; the default where none is valid."""
    found = F.transform(F.filter(F.split(text, ","), lambda x: F.trim(x).rlike("^[0-9]{1,2}$")), lambda x: F.trim(x).cast("int"))
    found = F.sort_array(F.array_distinct(F.filter(found, lambda x: x <= 90)), asc=False)
    return F.when(F.size(F.coalesce(found, F.array().cast("array<int>"))) > 0, found).otherwise(F.array(*map(F.lit, default)))


# The labels of the BL category, and the fields of the hash that peers compare.
BL_CATEGORIES = ["BL", "BL漫畫", "BL小說", "耽美漫畫", "耽美小說", "耽夢文庫"]
SYNC_FIELDS = ["publisher_code", "source_key", "title", "series_title", "volume_label", "edition_type", "media_type", "content_rating", "rating_raw", "rating_source", "rating_confidence", "author", "isbn", "cover_url", "list_price", "release_date", "release_precision", "release_status", "source_url"]


def bl_category(label: Column) -> Column:
    """The category that a label names, whatever its case, width and white space; null for any other."""
    own = F.replace(fold_key(label), F.lit(" "), F.lit(""))
    out = F.lit(None).cast("string")
    for name in BL_CATEGORIES:
        out = F.when(own == name.casefold(), name).otherwise(out)
    return out


def sync_hash(rows: DataFrame) -> Column:
    """SHA-256 of a row's SYNC_FIELDS as compact JSON with sorted keys; a column that rows lacks is null. Two control characters,
    which writers of JSON put in different cases, are taken out first."""
    clean = lambda f: F.translate(F.col(f), "\x0b\x1f", "") if rows.schema[f].dataType == T.StringType() else F.col(f)
    fields = [(clean(f) if f in rows.columns else F.lit(None).cast("string")).alias(f) for f in sorted(SYNC_FIELDS)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(T.StringType())
def spaced_hash(document: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object with sorted keys and a space after commas and colons, non-ASCII characters kept; null stays null."""
    return document.map(lambda d: None if d is None else hashlib.sha256(json.dumps(json.loads(d), ensure_ascii=False, sort_keys=True).encode()).hexdigest())


def calendar_event(end: str = "\r\n", prefix: str = "") -> Column:
    """The lines of a calendar's event from id, title, release_date, publisher_name, author and source_url."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("作者未提供"))
    lines = [
        F.lit("BEGIN:VEVENT"), F.concat(F.lit(f"UID:{prefix}"), value("id"), F.lit("@local")), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format("release_date", "yyyyMMdd")),
        F.concat(F.lit("SUMMARY:"), ics_escape(value("title"))), F.concat(F.lit("DESCRIPTION:"), value("publisher_name"), F.lit(" / "), author), F.concat(F.lit("URL:"), value("source_url")), F.lit("END:VEVENT"),
    ]
    return F.concat_ws(end, *lines)
