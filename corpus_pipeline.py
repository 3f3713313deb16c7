"""The corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskline.llm import bpe, line_dedup, quality_rules, simhash, source_mixing
from riskline.operators.lineage import written

#: Tokenizer of the last stage, and the SimHash limits of its contract.
TOKENIZER = "word_bpe_49k.json"
SHINGLE, RADIUS = 4, 4


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines are cut from the others."""
    return quality_rules.keep_clean(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of runs of lines go, and documents that hold nothing else."""
    return line_dedup.keep_first(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group of near copies stays."""
    return simhash.one_of_each(docs, SHINGLE, RADIUS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Source mixing: every document as often as the mix takes it."""
    return source_mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: token ids and decoded text beside the columns of the document."""
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_rules", clean),
    ("line_dedup", cut_repeats),
    ("simhash_near_dedup", one_of_each),
    ("source_mixing", mix),
    ("bpe", tokenize),
]

#: BPE has no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token table of the documents that pass all stages; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
