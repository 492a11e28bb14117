from kedrion.streaming import ingest as stream


def test_scans_over_arriving_files(spark, tmp_path):
    rows = [(0, "s", "Section", None, '{"level": "2"}'), (1, "t", "Section", None, "{}"), (2, "a", "Chunk", "слово", None), (3, "b", "Chunk", " 12 ", None), (4, "c", "Chunk", None, None)]
    for k in range(2):
        spark.createDataFrame([(r[0] + 10 * k, *r[1:]) for r in rows], stream.NODES).write.mode("append").parquet(f"file://{tmp_path}/in")
    nodes = stream.node_stream(spark, f"file://{tmp_path}/in")
    for name, scan in (("chunks", stream.chunks), ("sections", stream.sections)):
        query = scan(nodes).writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
    assert sorted((r.seq, r.text) for r in spark.table("chunks").collect()) == [(2, "слово"), (4, ""), (12, "слово"), (14, "")]
    assert sorted((r.seq, r.level) for r in spark.table("sections").collect()) == [(0, 2), (10, 2)]
