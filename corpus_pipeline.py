"""A corpus from raw documents: filter toxic texts, join near duplicates, decontaminate, mix, tokenise.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame with
the columns of documents; the last returns what its files hold. Stages are written and read again.

Null texts count as empty ones and pass every stage; rows without an id pass all decisions that are made by id and
stand in the token files under the smallest long; repeated rows share every decision; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsewarden.llm import decontaminate, mixing, ngram_join, shared, token_ids, toxicity

#: Target shares of tokens by domain; texts that the first stage took for toxic are gone.
WEIGHTS = {"plain": 0.85, "poor": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is low."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a five-word Jaccard of 0.8 or more, that with the smallest id."""
    return ngram_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their fitted rates, so that domains have their shares of tokens in a corpus of the same size."""
    return mixing.resample(docs, mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), WEIGHTS)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of coded token ids; per document what they hold."""
    return token_ids.read(token_ids.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_files),
]

#: The stages hold trained models and an external tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
    return docs
