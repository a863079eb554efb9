"""Corpus pipeline: toxicity filter, exact dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``.  ``run`` writes every stage as
parquet into the shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import bpe, dedup, simhash, toxicity, winnow
from riskspark.llm.common import table
from riskspark.session import checkpoint_path


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3.

    Null and empty texts are scored by the base rate of labels and stay unless most labels are toxic; rows that repeat a
    text have its score, whatever their ids; without labels of both kinds all rows get the base rate; an empty
    table stays empty."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id.

    Null and empty texts equal each other; a null id stays only if no other row has the text; of rows that repeat id and
    text one stays, ties being broken by the other columns; an empty table stays empty."""
    return dedup.drop_duplicates(docs, keep="max")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component (4-word shingles, 4 bits), the one with the smallest doc_id.

    Texts that are null or hold no word have fingerprint zero and link like any other; a null id stays only if its
    component has no other; of rows that repeat id and text one stays; an empty table stays empty."""
    return simhash.keep_first(docs, shingle=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (13-word windows, a twentieth of the words).

    Null texts and texts without words are clean; each row is judged by its own text, also where ids are null or repeated;
    an empty benchmark contaminates nothing; an empty table stays empty."""
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=13)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded bytes.

    Null counts as empty and has no tokens; every row gives one row, also where ids are null or repeated; an empty table
    stays empty."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontaminate), ("bpe", tokenise)]

#: SimHash components and learned scores have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = checkpoint_path(spark, "pipeline", uuid.uuid4().hex)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
