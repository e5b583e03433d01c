from datetime import datetime, timedelta

from lumeno.streaming import ingest


def test_stream_keeps_each_url_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(k, f"http://h{k % 3}/x", f"http://h{k % 3}/{k % 4}", t + timedelta(minutes=k), "<p>x</p>") for k in range(24)]
    spark.createDataFrame(rows, ingest.PAGES).write.parquet(f"{tmp_path}/in")
    stream = ingest.distinct_pages(ingest.pages(spark, f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    got = [r.actual_url for r in spark.table("once").collect()]
    assert sorted(got) == sorted({r[2] for r in rows})
    counts = ingest.hourly_counts(ingest.pages(spark, f"{tmp_path}/in"))
    q = counts.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("hours").collect()) == 24
