"""A corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last give the columns
of documents; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Scratch, table
from loomgraph.llm.line_dedup import dedup_lines
from loomgraph.llm.packing import pack
from loomgraph.llm.quality_rules import keep_good
from loomgraph.llm.similar import drop_similar
from loomgraph.llm.toxicity import drop_toxic

#: SQL can't express fitted models, XXH64 or a tokenizer; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash", simhash), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
