from glossmill.streaming import ingest


def test_upsert_and_history(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "line_no bigint, lang string, text string, v string"
    spark.createDataFrame([(1, "tr", "a", "1"), (2, "tr", "a", "2"), (3, "tr", "b", None)], schema).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    ingest.upsert_cache(stream(), out, str(tmp_path / "cp"), ["lang", "text"]).awaitTermination()
    spark.createDataFrame([(4, "tr", "b", "9")], schema).coalesce(1).write.mode("append").parquet(src)
    ingest.upsert_cache(stream(), out, str(tmp_path / "cp"), ["lang", "text"]).awaitTermination()
    assert sorted((r.text, r.v) for r in ingest.current(spark, out).collect()) == [("a", "2"), ("b", "9")]
    ev = str(tmp_path / "ev")
    spark.createDataFrame([(k, 1, k) for k in range(70)], "id bigint, owner int, ts bigint").write.parquet(ev)
    h = str(tmp_path / "h")
    ingest.append_history(spark.readStream.schema("id bigint, owner int, ts bigint").parquet(ev), h, str(tmp_path / "cp2"), "owner", "ts", "id").awaitTermination()
    assert sorted(r.id for r in ingest.current(spark, h).collect()) == list(range(10, 70))
    assert ingest.current(spark, str(tmp_path / "none")) is None
