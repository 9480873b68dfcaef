"""Series roll-up, volume gaps and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(books: DataFrame, keys: list[str], label: str, date: str, cover: str, id_col: str, owned: str) -> DataFrame:
    """One row a series. The cover is that of the latest dated book which has one; undated books come last."""
    return books.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("book_count"),
        F.countDistinct(label).alias("volume_count"),
        F.min(date).alias("first_date"),
        F.max(date).alias("latest_date"),
        F.count_if(F.col(owned)).alias("owned_count"),
        F.expr(f"max_by({cover}, struct({date} is not null, {date}, -{id_col})) filter (where {cover} is not null)").alias("latest_cover"),
    )


def gaps(books: DataFrame, keys: list[str], volume: str) -> DataFrame:
    """keys and missing_volume: numbers from 1 to the greatest that the series lacks."""
    have = books.where(F.col(volume) > 0).groupBy(*keys).agg(F.max(volume).alias("top"), F.collect_set(volume).alias("have"))
    return have.select(*keys, F.explode(F.array_except(F.sequence(F.lit(1), F.col("top")), "have")).alias("missing_volume"))


def evidence(rows: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """Merged recommendations: score of the first row by rank plus two for each other row, the reason of the best score."""
    w = Window.partitionBy(*keys)
    first = rows.withColumn("_n", F.row_number().over(w.orderBy(*rank))).withColumn("_count", F.count(F.lit(1)).over(w))
    best = F.first("reason").over(w.orderBy(F.col("score").desc(), *rank))
    return first.withColumn("best_reason", best).where("_n = 1").select(*keys, (F.col("score") + 2 * (F.col("_count") - 1)).alias("score"), F.col("best_reason").alias("reason"))
