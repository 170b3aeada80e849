"""Batches as a stream, and change detection by keyed state, against the batch forms."""

import json

from silverloom.operators import ingest
from silverloom.plans import engine
from silverloom.streaming import records as streaming


def test_stream_of_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    send = lambda n, *rows: (source / f"{n}.json").write_text(json.dumps({"records": [{"sourceRecordId": i, "fullName": x} for i, x in rows]}))
    send(1, ("a", "Ann"), ("b", "Bob"))
    worker = streaming.Ingestor(engine.State.empty(spark), "CRM", lambda n: f"2025-01-{n + 1:02d}T00:00:00Z")
    stream = streaming.read_json_stream(spark, str(source))
    worker.start(stream, str(tmp_path / "ck")).awaitTermination(120)
    send(2, ("a", "Anna"), ("b", "Bob"))
    worker.start(stream, str(tmp_path / "ck")).awaitTermination(120)
    send(3, ("c", "Cid"), ("c", "Cid"))
    worker.start(stream, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.source_record_id, r.revision_number, r.full_name) for r in worker.state["revisions"].collect()} == {("a", 1, "Ann"), ("b", 1, "Bob"), ("a", 2, "Anna")}
    assert worker.refused == [(2, "DUPLICATE_BATCH_ID")]


def test_keyed_state_equals_replay(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id", "event_id", "cast(floor(value / 200) as bigint) as level").limit(400)
    rows = events.orderBy("event_id").collect()
    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], events.schema).coalesce(1).write.mode("append").parquet(str(source / f"part={k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source) + "/part=*")
    found = streaming.changed_only(stream, "user_id", ["level"], "event_id")
    found.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.table("changes").collect()
    want = ingest.replay(events, ["user_id"], ["event_id"], ["level"]).collect()
    count = lambda rs, f: sorted((f(r), r.revision_number, r.payload_hash) for r in rs)
    assert count(got, lambda r: r.source_key) == count(want, lambda r: str(r.user_id))
