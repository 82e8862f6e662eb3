"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last keep the columns of documents, whatever their names; further columns of docs pass through. No documents
give none. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm import common, decontamination, mixing, ngram_join, pii, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, doesn't reject.

    Ids play no part. Null and empty texts are rejected where there are others to learn from; rows that repeat are judged
    alike. The result is a written table, as its scoring sends whole texts to Python."""
    with common.small_batches(spark):
        return common.write_table(quality.scored(docs, quality.fit(docs)).where("quality_keep").select(*docs.columns), "quality")[0]


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Documents without an id or without words stay; of rows that repeat an id with words one stays."""
    with common.small_batches(spark):
        return ngram_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item (or the whole of a shorter item).

    Null texts stay; without an id a document is judged by its text; rows of one id go together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    with common.small_batches(spark):
        return decontamination.clean(docs, items)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that reveal it generalised; n_chars follows the text.

    Null and empty texts stay as they are; rows that repeat are treated alike."""
    out = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's repetition rate and its own draw say, with size, rate and copy.

    A null source is a source of its own; rows of one id, or without one, are drawn alike; columns with the names of the
    new ones are replaced."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
]

#: SQL cannot express the trained stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with common.small_batches(spark), common.dropping() as kept:  # what operators wrote meanwhile
            docs, at = common.write_table(stage(spark, docs, sf_dir), "stage")
            kept.append(at)
        if last:
            common.drop_table(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
