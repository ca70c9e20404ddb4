"""From documents to token ids in five stages, each one operator over all that the stage before
kept. A stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of
documents. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import host_rules, jaccard_join, mixing, piece_codec, substring_dedup
from tesserae.llm.common import Scratch, dropped_after

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null or empty text has no words and is rejected; a null
    source is a host of its own; repeated rows are judged each and stay or go together."""
    return host_rules.host_rules(docs, keep=COLUMNS).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents one row, that with the least id, stays: of rows equal in all
    columns one, of one id with two texts a row for each class. Null ids come after all others, and
    texts without words all stay."""
    return jaccard_join.one_of_each(docs, jaccard_join.similar_texts(docs, verdicts=True)).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out of the texts; rows stay. Null and empty texts
    come back as they are; null ids rank last."""
    cleaned = substring_dedup.dedup_passages(docs)
    return cleaned.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. A null source is a source of
    its own; an empty text has size 0 and can be taken; repeated rows are taken one by one."""
    return mixing.taken_rows(mixing.mix_sources(docs, keep=COLUMNS)).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it. A null text is the end id alone; rows repeat as
    often as they were taken."""
    coded = piece_codec.encode_texts(docs, piece_codec.default_model(), keep=["doc_id", "lang", "source", "text"], decoded="decoded")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: Shingle links, hashed units and subword merges have no SQL here; tests/llm compares run()
#: with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with dropped_after():  # a stage's inner tables go once its rows are written
            docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
