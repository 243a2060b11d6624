"""From raw documents to token ids in five stages; each reads all that the one before kept.

Every stage judges each row by its own text: rows of a repeated or null id stay or go each by itself. Null texts count as
empty, an empty table gives an empty table, and columns beyond those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import bpe, jaccard, leaks, lines, quality
from graphspark.llm._store import saved

#: Ids and hashes of so many rows, 16 bytes each, are broadcast; more are joined by shuffle.
MOST_BROADCAST = 2_000_000

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more stay; it is fitted on the labels' documents in docs.

    Null texts count as empty and are judged as such; without labels all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    return quality.score(docs, model, list(COLUMNS)).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on three sites or more go, but for their first occurrence; all documents stay, n_chars is counted anew."""
    out = lines.remove_boilerplate(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays; texts without words are no duplicates.

    Rows that repeat that id and its text stay too; documents of null ids go where their component has an id."""
    found = jaccard.jaccard_components(docs)
    gone = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "content").distinct()
    return _without(docs, gone, F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage near to a benchmark item go."""
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))  # of rows of one id each is judged by itself
    found = leaks.leaks(docs.withColumn("row", row), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    gone = found.select("doc_id").distinct().withColumn("content", F.lit(0).cast("long"))
    return _without(docs, gone, row, F.lit(0).cast("long"))


def _without(docs: DataFrame, gone: DataFrame, row: Column, content: Column) -> DataFrame:
    """docs but for rows whose (row, content) are in gone (doc_id, content), which is written once."""
    kept = saved(gone.select(F.col("doc_id").alias("gone_id"), F.col("content").alias("gone_content")), "gone")
    small = F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept
    same = F.col("row_content") == F.col("gone_content"), F.col("row_id").eqNullSafe(F.col("gone_id"))
    marked = docs.select(*COLUMNS).withColumn("row_id", row).withColumn("row_content", content)
    return marked.join(small, [*same], "left_anti").select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, digests of the ids and of what they decode to."""
    return bpe.digests(docs, carry=("doc_id", "lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("byte-level BPE", token_stage),
]

#: A learned classifier, a similarity join and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
