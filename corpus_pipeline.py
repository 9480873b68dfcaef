"""A corpus pipeline of the operators in kura.llm: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kura.llm import line_dedup, ngram_join, packing, quality, secrets
from kura.llm.common import materialize, table


def recount(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars of its present texts."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose verdict is kept."""
    return quality.keep_good(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines that an earlier document has; documents of which nothing is left go."""
    return recount(line_dedup.keep_rest(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8, that of least doc_id. Rows that share a
    doc_id are told apart by their texts; rows without a doc_id are not compared and stay."""
    if not ngram_join.repeats(docs):
        groups = ngram_join.join_unique(docs.select("doc_id", "text"), "text", "doc_id", n=5, percent=80)
        others = groups.where("doc_id <> component_id").select("doc_id")
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    held = ngram_join.numbered(docs)
    groups = ngram_join.join_unique(held, "text", "kura_row", n=5, percent=80).where("doc_id is not null").withColumnRenamed("doc_id", "kura_row").join(held.select("kura_row", "doc_id"), "kura_row")
    keep = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "kura_row"))["kura_row"].alias("kura_row")).select("kura_row")
    kept = held.join(keep, "kura_row", "left_semi").select(*docs.columns)
    return kept.unionByName(held.where("kura_row is null").select(*docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked."""
    return recount(secrets.redact(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising, alignment and linking aren't expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
