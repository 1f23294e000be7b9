"""The corpus pipeline: stages over documents, each written as Parquet and read
again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import dp_packing, exact_dedup, mixing, string_kernel, tensor_minhash
from weftgraph.llm.common import forget, scratch, written

#: Similarity of near-duplicates, in percent; op4's own is higher.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told by the kernel go: those without a letter,
    and those whose n-grams the landmarks mostly lack."""
    return string_kernel.keep_identified(docs)


def drop_exact_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_repeats(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one with the smallest doc_id stays."""
    return tensor_minhash.drop_near_duplicates(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where it cuts them."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows, with their ids."""
    return dp_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_repeats),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No SQL expresses the kernel, the minhashes, the schedule or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what the stage wrote on its way goes
            docs = written(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        forget(spark, *last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
