"""The event-time plan over files gives the batch result."""

from pyspark.sql import functions as F

from plait.sources.catalog import SCHEMAS, Database
from plait.streaming.events import read_files, windowed_counts

PATH = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    spark.read.parquet(f"{PATH}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(read_files(spark, str(tmp_path / "in"), SCHEMAS["events"]), "ts", "event_type", "value")
    q = stream.writeStream.format("memory").queryName("out").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.table("out").collect()}
    batch = Database(spark, PATH).frame("events").groupBy(F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("start"), "event_type").count()
    assert got == {(r.start, r.event_type): r["count"] for r in batch.collect()}


def test_other_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for kind in ("json", "orc", "csv"):
        rows.write.format(kind).save(str(tmp_path / f"t.{kind}"))
        db = Database(spark, str(tmp_path), {})
        db.register("t", "id int, s string", format=kind)
        assert sorted((r.id, r.s) for r in db.table("t").to_list()) == [(1, "a"), (2, None)]
