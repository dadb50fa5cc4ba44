"""Streams give what the batch gives."""

import datetime as dt

from quern import streaming
from quern.operators.embed import embed


def test_event_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), "a" if m % 2 else "b", float(m)) for h in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming.event_counts(streaming.tail_parquet(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(streaming.event_counts(df).collect())


def test_files_are_ingested_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("one\n\ntwo")
    streaming.ingest_files(spark, src, out, check).awaitTermination()
    (tmp_path / "src" / "b.md").write_text("# three\n\nfour")
    streaming.ingest_files(spark, src, out, check).awaitTermination()
    streaming.ingest_files(spark, src, out, check).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["four", "one", "three", "two"]


def test_backfill_embeds_active_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "active", "a"), (1, "active", "a"), (2, "deleted", "b")], "id long, status string, content string")
    df.write.parquet(str(tmp_path / "in"))
    streaming.backfill(spark, str(tmp_path / "in"), df.schema, lambda b: embed(b, "id", "content"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]
