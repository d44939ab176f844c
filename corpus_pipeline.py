"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage takes a table with the columns of ``documents``, and any others, which stay, whatever their names; an
empty table gives an empty one.  Null and empty texts are rows like any other; texts of any length count whole;
ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.llm import decontaminate, line_dedup, packing, simhash, toxicity
from loomframe.llm.common import materialize, release


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the model learns from the labelled documents among ``docs``.

    A null or empty text has the score of a text on which no voter fires, and stays; repeated rows stay or go
    together; a score of 0.7 goes; without both labels among the documents all have the share of toxic ones as score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of line runs of 50 words and more; n_chars follows the text.

    Null and empty texts stay as they are, n_chars with them; rows of equal id and text are one document; null ids
    come last; of equal runs the one of the smallest id, and in it the first, stays.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts are one class; of repeated rows one stays; rows without an id stay only in classes that have
    no id at all, one of each.
    """
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited in up to 15 % of its bytes.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; null and empty items, and an empty
    benchmark, let all stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids: each row's ids once, those of repeated rows once for each; a null text has one id."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_repeated_lines), ("simhash_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("packing", pack_windows)]

#: No SQL: a fitted classifier, hashes of shingles, an edit-distance search and a tokenizer are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, was = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        release(was)
    return STAGES[-1][1](spark, docs, sf_dir)
