from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from pulsewarden.llm import shared


def test_stages_on_the_small_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, ids = source, [{r.doc_id for r in source.select("doc_id").collect()}]
    rows = [source.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        rows.append(docs.count())
        assert ids[-1] <= ids[-2]
        if name != "token_ids":
            assert docs.columns == source.columns
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert not toxic & ids[1] and len(clean - ids[1]) <= 1
    assert ids[4] == ids[5] and 0.9 * rows[3] < rows[4] < 1.1 * rows[3] and rows[4] == rows[5]
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_stages_take_nulls_and_repeats(spark):
    """Null texts and ids, empty texts and repeated rows pass every stage; only the toxic text goes and one of the near copies."""
    sf_dir = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    some = source.orderBy("doc_id").limit(20)
    odd = some.limit(4).withColumn("doc_id", F.col("doc_id") + 900000).withColumn("text", F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.lit("")))
    docs = some.unionByName(some.limit(3)).unionByName(odd).unionByName(some.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.cut(stage(spark, docs, sf_dir), name)
        if name == "mixing":
            assert docs.columns == source.columns
    assert docs.count() > 10
    empty = source.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
