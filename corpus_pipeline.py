"""A training-data pipeline of five stages over the table documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. The classifiers are
fitted on the tables in sf_dir and applied to docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm.common import delete_written, written, written_tables
from tracklens.llm.linedup import drop_repeated_lines
from tracklens.llm.packing import ids_crc32, packed
from tracklens.llm.probminhash import one_of_each_class
from tracklens.llm.quality import quality_score
from tracklens.llm.queries import MIXTURE, quality_model, toxicity_model
from tracklens.llm.toxicity import toxicity_score


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (below 0.7) go."""
    return docs.filter(quality_score("text", quality_model(spark, sf_dir)) >= 0.7)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects (0.5 or more) go."""
    return docs.filter(toxicity_score("text", toxicity_model(spark, sf_dir)) < 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; every document stays, with its new text and length."""
    shorter = drop_repeated_lines(docs)
    return shorter.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays; rows without an id or a text are in no class and stay."""
    return one_of_each_class(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2,048 tokens."""
    pieces = packed(docs, targets=MIXTURE)
    return pieces.select("doc_id", "start", "length", ids_crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: The classifiers, the sketches and the tokeniser can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has left in the shared folder goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    older = set(written_tables(spark))
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            needed_no_more = [path for path in written_tables(spark) if path not in older]
            docs = written(docs, name.replace(" ", "-"))
            delete_written(spark, needed_no_more)
    return docs
