"""Pairing of incoming rows with catalog rows, import plans and the checks of an upload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kura.functions.text import fold_key, normalize_text

from .tables import redirect

# What an upload may hold.
MEDIA_TYPES = ["manga", "novel"]
CHOICES = {
    "content_rating": ["unknown", "general", "protected_6", "guidance_12", "guidance_15", "restricted_18"],
    "release_precision": ["unknown", "day", "month", "year"],
    "release_status": ["unknown", "scheduled", "available"],
    "rating_source": ["unknown", "publisher", "category"],
    "release_date_source": ["unknown", "schedule", "product"],
}
REQUIRED = {"publisher_code": 100, "source_key": 190, "title": 500, "source_url": 1000}
MOST_PRICE = 10_000_000
MOST_UPLOAD = 200
# And how authors are listed.
BETWEEN_AUTHORS = "[、,，/／;；]+"
ROLE = r"^\s*(?:作者|原作|作畫|繪者|插畫|著)[:：]\s*"


def sole_match(incoming: DataFrame, catalog: DataFrame, id_col: str, criteria: list[list[str]]) -> DataFrame:
    """incoming with matched_id: the only catalog row that meets any criterion, null where there is none or several.

    A criterion is a list of columns that must be equal; null equals nothing. The catalog side is one row a key (least
    and greatest id), so a hot key makes no pairs: a match is the only one when the least of all least ids is the
    greatest of all greatest."""
    out, low, high = incoming, [], []
    for i, columns in enumerate(criteria):
        keys = [f"_k{i}_{c}" for c in columns]
        filled = [F.col(c).cast("string").alias(k) for c, k in zip(columns, keys, strict=True)]
        ends = catalog.select(*filled, F.col(id_col)).dropna(subset=keys).groupBy(*keys).agg(F.min(id_col).alias(f"_lo{i}"), F.max(id_col).alias(f"_hi{i}"))
        out = out.select("*", *filled).join(ends, keys, "left").drop(*keys)
        low.append(f"_lo{i}")
        high.append(f"_hi{i}")
    least, most = (F.least(*low), F.greatest(*high)) if len(criteria) > 1 else (F.col(low[0]), F.col(high[0]))
    return out.withColumn("matched_id", F.when(least == most, least)).drop(*low, *high)


def pair_planned(incoming: DataFrame, catalog: DataFrame, id_col: str, planned: str, criteria: list[list[str]]) -> DataFrame:
    """Planned rows are paired with lasting rows of the catalog and the other way round; planned is a boolean column in both."""
    sides = [sole_match(incoming.where(mine), catalog.where(theirs), id_col, criteria) for mine, theirs in ((F.col(planned), ~F.col(planned)), (~F.col(planned), F.col(planned)))]
    return sides[0].unionByName(sides[1])


def tokens(authors: Column) -> Column:
    """The distinct names in a list of authors, without roles, white space and case."""
    names = F.split(fold_key(F.coalesce(authors, F.lit(""))), BETWEEN_AUTHORS)
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.regexp_replace(F.regexp_replace(x, ROLE, ""), r"\s+", "")), lambda x: x != ""))


def richer_authors(new: Column, old: Column) -> Column:
    """The old authors where they include all the new ones, or where the new ones are empty."""
    mine, theirs = tokens(new), tokens(old)
    return F.when(F.size(F.array_except(mine, theirs)) == 0, F.coalesce(old, new)).otherwise(new)


def import_plan(rows: DataFrame, owned: DataFrame, valid: DataFrame, merges: DataFrame, owner: str = "user_id", item: str = "book_id", section: str = "section", order: str = "position") -> DataFrame:
    """rows with canonical_id and state: missing (no such item), existing (owned, or earlier in the rows) or new.

    owned has owner, section and item, valid has item, merges has old_id and new_id. Null items are missing;
    of rows with equal keys and order any one is new."""
    moved = redirect(rows, merges, item)
    known = valid.select(F.col(item).alias("canonical_id"), F.lit(True).alias("_valid")).distinct()
    have = owned.select(F.col(owner), F.col(section), F.col(item).alias("canonical_id"), F.lit(True).alias("_owned")).distinct()
    earlier = F.row_number().over(Window.partitionBy(owner, section, "canonical_id").orderBy(order)) > 1
    out = moved.withColumn("_again", earlier).join(have, [owner, section, "canonical_id"], "left").join(known, "canonical_id", "left")
    state = F.when(F.col("_valid").isNull(), "missing").when(F.col("_owned") | F.col("_again"), "existing").otherwise("new")
    return out.withColumn("state", state).drop("_valid", "_owned", "_again")


def checked(rows: DataFrame) -> DataFrame:
    """rows of strings with error, the first rule that a row breaks, else null. An empty media type is unknown, which is none that an
    upload may hold; other empty choices are unknown, which is one.

    Reads publisher_code, source_key, title, source_url, media_type, list_price, release_date and rating_confidence, and of CHOICES
    the columns that rows has."""
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    need = lambda c: (full(c) == "", f"{c} is required")
    choice = lambda c: [(~F.lower(full(c)).isin("", *CHOICES[c]), f"Invalid {c}")] if c in rows.columns else []
    price, date = F.nullif(full("list_price"), F.lit("")), F.nullif(full("release_date"), F.lit(""))
    share = F.nullif(full("rating_confidence"), F.lit(""))
    wrong = [
        need("publisher_code"), need("source_key"), need("title"),
        (~F.lower(full("media_type")).isin(MEDIA_TYPES), "Invalid media_type"),
        need("source_url"),
        (~full("source_url").rlike("^https?://[^/?#]+"), "source_url must be an http(s) URL"),
        *choice("content_rating"),
        (price.isNotNull() & ~price.rlike("^[+-]?[0-9]+$"), "list_price must be an integer"),
        (price.isNotNull() & ~F.coalesce(price.try_cast("decimal(38,0)").between(0, MOST_PRICE), F.lit(False)), "list_price is outside the accepted range"),
        (share.isNotNull() & ~share.rlike("^[+-]?[0-9]+$"), "rating_confidence must be an integer"),
        (date.isNotNull() & F.substring(date, 1, 10).try_cast("date").isNull() | date.isNotNull() & ~date.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "release_date must use YYYY-MM-DD"),
        *choice("release_precision"), *choice("release_status"), *choice("rating_source"), *choice("release_date_source"),
    ]
    return rows.withColumn("error", reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(wrong), F.lit(None).cast("string")))


def fitted(rows: DataFrame) -> DataFrame:
    """rows with each required text normalised and cut to what the catalog holds; an empty one is null."""
    return rows.withColumns({c: F.nullif(F.left(normalize_text(F.col(c)), F.lit(n)), F.lit("")) for c, n in REQUIRED.items()})


def batches_without_errors(rows: DataFrame, batch: str = "batch", most: int = MOST_UPLOAD) -> DataFrame:
    """batch, n_items, n_errors and accepted: a batch is taken whole or not at all, and not beyond most rows."""
    out = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("n_items"), F.count("error").alias("n_errors"))
    return out.withColumn("accepted", (F.col("n_errors") == 0) & (F.col("n_items") <= most))
