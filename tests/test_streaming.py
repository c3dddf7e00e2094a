from quillon.schemas import SPLIT_DOCUMENT
from quillon.streaming import landing


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"d{i}", " ".join(f"w{j}" for j in range(i)), [(0, 2, "w0", "L", None)] if i else None, "train" if i % 2 else "dev") for i in range(30)]
    df = spark.createDataFrame(rows, SPLIT_DOCUMENT)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    for name, make in (("tags", landing.tagged_chunks), ("text", landing.generated_chunks)):
        query = landing.write_stream(make(landing.landed_records(spark, str(tmp_path / "in")), 10, 3), str(tmp_path / name), str(tmp_path / f"c-{name}"))
        query.awaitTermination(60)
        assert {str(r) for r in spark.read.parquet(str(tmp_path / name)).collect()} == {str(r) for r in make(df, 10, 3).collect()}


def test_counts_in_complete_mode(spark, tmp_path):
    spark.createDataFrame([("a", "x", [], "dev"), ("b", "y", [(0, 1, "y", "L", None)], "dev")], SPLIT_DOCUMENT).write.parquet(str(tmp_path / "in"))
    counts = landing.split_counts(landing.landed_records(spark, str(tmp_path / "in")))
    query = counts.writeStream.format("memory").queryName("counts_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("counts_test").collect()] == [("dev", 2, 1)]
