"""The queries of the text operators, as the driver's entry lists them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewarden.llm import collocations, decontaminate, filter_audit, line_dedup, mixing, ngram_join, sentencepieces, suffix_dedup, token_ids, topk_search, toxicity, url_filter, warc

#: Target shares of tokens by domain.
MIXTURE = {"plain": 0.8, "poor": 0.15, "toxic": 0.05}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.quality_domains(_table(spark, sf_dir, "labels"))
    return mixing.mix(_table(spark, sf_dir, "documents"), labels, MIXTURE)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(_table(spark, sf_dir, "documents"), every=True).drop("kept")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return topk_search.search(docs, docs.where(F.col("doc_id") % 50 == 0))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_ids.read(token_ids.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("toxic", F.col("severity") >= toxicity.CUT)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read(warc.write(_table(spark, sf_dir, "pages"))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.Filter(url_filter.RULES).fit(url_filter.labelled_by_rules(pages, url_filter.RULES)).judge(pages)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.digest(sentencepieces.encode(_table(spark, sf_dir, "documents"), path), path)


def queries() -> dict:
    import corpus_pipeline

    found = (op1_token_ids, op2_ngram_join, op3_mixing, op4_line_dedup, op5_topk_search, op6_decontaminate, op7_toxicity, op8_warc, op9_url_filter, op10_suffix_dedup,
             op11_collocations, op12_filter_audit, op13_sentencepiece)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": warc.SQL, "op11_collocations": collocations.SQL, "op12_filter_audit": filter_audit.SQL}
