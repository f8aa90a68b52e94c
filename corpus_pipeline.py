"""A corpus pipeline of five stages: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it back as the next stage's documents. All but the last stage return the
columns of documents. Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm.common import stored, table
from patchloom.llm.mixing import mixed_documents
from patchloom.llm.ngram_join import ngram_jaccard_join
from patchloom.llm.packing import packed_digest
from patchloom.llm.quality import THRESHOLD, score_quality, train_fold
from patchloom.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score 0.7 or more; the classifier learns from the tables' training fold. Without labels nothing is rejected."""
    model = train_fold(spark, sf_dir)
    return docs if model is None else score_quality(docs, model, score_col="_score").where(F.col("_score") >= THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row with the least id, and of rows with that id the first as stored; a null id comes last.

    Rows are joined by their number, so rows that repeat an id or have none are grouped by their texts like all others.
    Texts without a word are in no group: only repeats of one id and text are one.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = ngram_jaccard_join(numbered, id_col="_row").documents
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    blank = F.col("n_shingles") == 0
    wordless = F.when(F.col("text").rlike(r"\A[\x20\x09-\x0D]*\z"), F.col("text"))
    groups = groups.join(numbered.select("_row", "doc_id", wordless.alias("text")), "_row")
    groups = groups.select("_row", "doc_id", F.when(~blank, F.col("component_id")).alias("_group"), F.when(blank, F.struct("doc_id", "text")).alias("_same"))
    keep = groups.groupBy("_group", "_same").agg(least.alias("_least")).select(F.col("_least._row").alias("_row"))
    return numbered.join(keep, "_row").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars follows the text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a row for each reading of a document."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packed_digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: No SQL: a trained classifier and a tokenizer; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
