"""The corpus pipeline: five operators of tessera.llm, one after the other over all documents.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared folder and reads again as the next one's docs. Columns are those of ``documents`` until the
last stage adds size, shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, stash, table
from tessera.llm.decontamination import decontaminate
from tessera.llm.jaccard_join import deduplicate
from tessera.llm.language_id import UND, held_out, identify, train
from tessera.llm.mixing import mix
from tessera.llm.sharding import shard


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with that language; those without a letter go.

    Where no document names a language, nothing can be told, and all with a letter stay as they are.
    """
    bound_batches(spark)
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = identify(docs, model, spans=False).where(F.col("lang_pred") != UND)
    return told.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    bound_batches(spark)
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the spans that they share with a benchmark item; one that is nothing else goes."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0 OR n_hit < n_words")
    text = F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col("text"))
    changed = F.when(F.col("n_hit") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).withColumn("text", text).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    bound_batches(spark)
    mixed = mix(docs)
    return mixed.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard of 16, of near equal bytes, and its slot there."""
    bound_batches(spark)
    return shard(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Bytes of a row group, which each writing task holds: with the default of 128 MB, a stage's writers take most of a small heap.
ROW_GROUP = 16 << 20

#: Language models, signature trees and seeded samples have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}", **{"parquet.block.size": str(ROW_GROUP)})
    return STAGES[-1][1](spark, docs, sf_dir)
