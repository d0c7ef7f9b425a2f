"""The corpus pipeline: language ID, MinHash near-dedup, substring dedup, best-fit packing.

Each stage gets what the one before kept, as written Parquet; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import langid, neardup, packing, substring
from quoin.llm.queries import WORD_BPE, documents
from quoin.runtime import durable, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which a language is recognised, labelled with it; texts without letters (`und`) go."""
    ship(spark)
    return langid.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, 0.8), that with the smallest doc_id. Rows without words are no group's.

    Rows without a doc_id go if a document of their group has one; groups of such rows alone stay.
    """
    ship(spark)
    found = neardup.near_duplicates(docs, k=5, percent=80)
    gone = durable(found.where("not kept").select(F.col("key").alias("its key")).distinct(), "gone")
    keyed = docs.withColumn("its key", neardup.key_of(F.col("doc_id"), F.col("text"))).repartition("its key")
    return keyed.join(gone, "its key", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 48 words or more that occur earlier; documents of which nothing is left go. Null texts stay; of equal places the smallest doc_id keeps its passage."""
    ship(spark)
    done = substring.substring_dedup(docs, more=("removed spans", "number of units"))
    return done.where(~((F.size("`removed spans`") > 0) & (F.trim("text") == ""))).select(*[f"`{c}`" for c in docs.columns])


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of 2048 ids; null texts are empty ones, and pieces of one length are packed in the order of a hash."""
    ship(spark)
    return packing.pack(packing.pieces(docs, WORD_BPE))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("best_fit", best_fit)]

#: Shingle links, automata and subword ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
