import pyarrow as pa
from pyspark.sql import functions as F

from pulsewarden.llm import shared


def test_folders_are_qualified(spark):
    folder = shared.shared_folder(spark, "some")
    assert folder.startswith("file:/") and "/some-" in folder
    store, path = shared.filesystem(folder)
    assert store.type_name == "local" and path == "/" + folder.split(":", 1)[1].lstrip("/")


def test_batches_are_bounded_by_bytes(spark):
    shared.small_batches(spark)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 2 << 20).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]) for b in batches), "n long").toPandas()["n"]
    assert sizes.sum() == 40 and sizes.max() <= (shared.ARROW_BYTES >> 21) + 1


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n]}) for n in (10, 10, 90, 1)] + [pa.RecordBatch.from_pydict({"text": pa.array([], pa.string())})]
    got = [b.column(0).to_pylist() for b in shared.gathered(batches, 50)]
    assert [len(x) for x in got] == [2, 1, 1] and sum(got, []) == [b.column(0)[0].as_py() for b in batches[:4]]
