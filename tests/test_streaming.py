from pyspark.sql import functions as F

from tallyweave.streaming.moments import running_moments, watch


def test_a_stream_ends_with_the_moments_of_all_its_rows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = watch(stream, ["value"], "moments_seen")
    query.processAllAvailable()
    query.stop()
    got, want = (d.first().asDict() for d in (spark.table("moments_seen"), running_moments(events, ["value"])))
    assert {k: round(v, 6) if isinstance(v, float) else v for k, v in got.items()} == {k: round(v, 6) if isinstance(v, float) else v for k, v in want.items()}
