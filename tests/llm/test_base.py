from pyspark.sql import functions as F

from weftline.llm import base


def test_first_by_hash_is_the_order_by_hash(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    for size in (1, 50, 1000, 4000, 9000):
        want = [r[0] for r in df.orderBy(base.place_of("doc_id"), "doc_id").limit(size).collect()]
        assert [r[0] for r in base.first_by_hash(df, ["doc_id"], size).collect()] == want
    assert base.first_by_hash(df.limit(0), ["doc_id"], 5).count() == 0


def test_first_by_hash_of_one_value(spark):
    df = spark.range(3000).select(F.lit(7).alias("doc_id"))
    assert base.first_by_hash(df, ["doc_id"], 10).count() == 10


def test_written_tables_go_when_dropped(spark):
    path = base.new_folder(spark, "t")
    spark.range(3).write.parquet(path)
    assert path.startswith(base.shared_dir(spark)) and spark.read.parquet(path).count() == 3
    base.drop_folder(spark, path)
    assert base.written(spark.range(2), "u").count() == 2


def test_text_chunks_cut_by_bytes():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 100, "", "c" * 5]
    b = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [c.column("text").to_pylist() for c in base.text_chunks([b, b.slice(0, 0)], size=16)]
    assert [t for p in parts for t in p] == texts and len(parts) > 1
    assert [c.num_rows for c in base.chunks([b], 2)] == [2, 2, 1]
