"""Whole-table operators: paging, overlays, merges, diffs and change capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page; the order should end in a unique key."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def keyset(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The page after a key, with one row more that shows whether there is another page."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit + 1)


def overlay(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put over those of the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def drop_keys(old: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return old.join(keys, on, "left_anti")


def redirect(df: DataFrame, merges: DataFrame, id_col: str = "id") -> DataFrame:
    """df with canonical_id: where an id was merged into another one, that one. merges has old_id, new_id."""
    return df.join(merges, F.col(id_col) == F.col("old_id"), "left").withColumn("canonical_id", F.coalesce("new_id", id_col)).drop("old_id", "new_id")


def diff(local: DataFrame, remote: DataFrame, key: str, digest: str) -> DataFrame:
    """state of each key: same, local_only, remote_only or different."""
    both = local.select(key, F.col(digest).alias("l")).join(remote.select(key, F.col(digest).alias("r")), key, "full_outer")
    return both.select(key, F.when(F.col("r").isNull(), "local_only").when(F.col("l").isNull(), "remote_only").when(F.col("l") == F.col("r"), "same").otherwise("different").alias("state"))


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def history(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row (key, field, old_value, new_value) for every field that differs, nulls included."""
    both = old.select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields]).join(new.select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields]), key)
    stacked = both.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old_value"), F.col(f"n_{f}").alias("new_value")) for f in fields])).alias("x"))
    return stacked.select(key, "x.*").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A full outer merge with action inserted, updated, unchanged or kept; rules give columns of o.* and n.*."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    merged = both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), there.alias("_o"), came.alias("_n"), *[v.alias(f) for f, v in rules.items()], *[F.col(f"o.{f}").alias(f"_o_{f}") for f in rules])
    changed = F.lit(False)
    for f in rules:
        changed = changed | ~F.col(f).eqNullSafe(F.col(f"_o_{f}"))
    action = F.when(~F.col("_o"), "inserted").when(~F.col("_n"), "kept").when(changed, "updated").otherwise("unchanged")
    return merged.select(key, *rules, action.alias("action"))


def filled(new: Column, old: Column) -> Column:
    """An empty value never replaces another."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def islands(df: DataFrame, order: list[Column], hit: Column, partition: list[str] | None = None) -> DataFrame:
    """df with run: the length so far of the current run of hits, 0 outside one. Runs are told apart by a running count."""
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    marked = df.withColumn("_hit", hit.cast("int")).withColumn("_grp", F.sum(F.lit(1) - F.col("_hit")).over(w))
    runs = Window.partitionBy(*(partition or []), "_grp").orderBy(*order)
    return marked.withColumn("run", F.sum("_hit").over(runs)).drop("_hit", "_grp")
