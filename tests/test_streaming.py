from mnemix.streaming import current, ingest_stream


def test_batches_upsert(spark, tmp_path):
    schema = "doc_seq long, text string, source string"
    src, table, ck = (str(tmp_path / n) for n in ("src", "table", "ck"))
    spark.createDataFrame([(1, "Hello there. More.", "s")], schema).write.parquet(src)
    for seq in (2, 3):
        ingest_stream(spark.readStream.schema(schema).parquet(src), table, ck).awaitTermination()
        spark.createDataFrame([(seq, "Hello there. More.", "s"), (seq, f"Number {seq} is new.", "s")], schema).write.mode("append").parquet(src)
    ingest_stream(spark.readStream.schema(schema).parquet(src), table, ck).awaitTermination()
    got = current(spark, table)
    assert got.count() == got.select("id").distinct().count() == 3
