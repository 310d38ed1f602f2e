"""A training-corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from framewise.llm import bpe, linededup, mixing, quality, simhash
from framewise.llm.common import bound_batches
from framewise.llm.queries import tokenizer_path
from framewise.session import ensure_checkpoint_dir, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance-resampling classifier keeps."""
    bound_batches(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that nearly repeat an earlier line."""
    bound_batches(spark)
    return linededup.drop_duplicate_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near copies."""
    bound_batches(spark)
    return simhash.drop_near_duplicates(docs, shingle=3, distance=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix of sources, repeated as often as it copies them."""
    bound_batches(spark)
    return mixing.draw(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document."""
    bound_batches(spark)
    return bpe.digests(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("simhash", simhash_stage), ("mixing", mixing_stage),
          ("bpe", bpe_stage)]

# Hashes, models and iterations are not SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared checkpoint folder, each for as long as the next
    stage reads it."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            _remove(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
