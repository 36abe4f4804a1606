import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from joblode.operators.ingest import ingest_into
from joblode.sources.landing import payload_table
from joblode.sources.store import JobTable
from joblode.streaming.ingest import start_ingest
from joblode.streaming.ratecap import rate_cap_stream

NOW = datetime(2026, 3, 22, 12, 0, tzinfo=timezone.utc)


def land(root, name, url, title):
    folder = root / "source=remotive"
    folder.mkdir(parents=True, exist_ok=True)
    body = {"jobs": [{"id": name, "url": url, "title": title, "publication_date": "2026-03-20"}]}
    (folder / f"{name}.json").write_text(json.dumps(body))


def test_continuous_ingest(spark, tmp_path):
    landing, table = tmp_path / "landing", JobTable(spark, str(tmp_path / "table"))

    def run(clock):
        query = start_ingest(
            spark, str(landing), table, str(tmp_path / "checkpoint"), clock=lambda: clock, available_now=True
        )
        query.awaitTermination(120)
        assert query.exception() is None

    land(landing, "a", "https://x.test/1", "Junior Dev")
    run(NOW)
    land(landing, "b", "https://x.test/1", "Senior Dev")
    land(landing, "c", "https://x.test/2", "Ops")
    run(NOW + timedelta(days=1))
    rows = {r.source_job_url: r for r in table.read().collect()}
    assert {u: (r.title, r.freshness_days) for u, r in rows.items()} == {
        "https://x.test/1": ("Senior Dev", 3), "https://x.test/2": ("Ops", 3),
    }
    first = rows["https://x.test/1"]
    assert (first.created_at, first.updated_at) == (datetime(2026, 3, 22, 12), datetime(2026, 3, 23, 12))
    assert table.commits().count() == 2


def test_a_second_checkpoint_does_not_hide_its_data(spark, tmp_path):
    table = JobTable(spark, str(tmp_path / "table"))
    for place in ("one", "two"):
        land(tmp_path / place, place, f"https://x.test/{place}", place)
        (tmp_path / place / "source=village").mkdir()
        (tmp_path / place / "source=village" / "bad.json").write_text("[1]")
        query = start_ingest(spark, str(tmp_path / place), table, str(tmp_path / f"checkpoint-{place}"), clock=lambda: NOW, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r.title for r in table.read().collect()) == ["one", "two"]
    assert [r.reject_reason for r in table.rejected().collect()] == ["record_not_object"] * 2


def test_streaming_cap_carries_state_between_triggers(spark, tmp_path):
    source = tmp_path / "events"
    start = datetime(2026, 1, 1)
    batches = [[(1, 0, 1), (1, 0, 2), (1, 30, 3), (2, 5, 4)], [(1, 60, 5), (1, 61, 6), (1, 62, 7), (2, 64, 8), (2, 65, 9)],
               [(1, -900, 10), (1, None, 11), (None, 5, 12), (1, 500, 13)]]
    schema = "k int, ts timestamp, e int"
    got = {}

    def keep(frame, _):
        got.update({r.e: r.accepted for r in frame.collect()})

    for batch in batches:
        rows = [(k, None if s is None else start + timedelta(seconds=s), e) for k, s, e in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        capped = rate_cap_stream(stream, "k", "ts", "e", 2, 60, "10 minutes")
        query = (
            capped.writeStream.outputMode("append").foreachBatch(keep)
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False, 8: True, 9: True, 10: False, 11: False, 12: True, 13: True}


def test_state_of_idle_keys_expires(spark, tmp_path):
    source, start = tmp_path / "events", datetime(2026, 1, 1)
    schema = "k string, ts timestamp, e int"
    got, kept = {}, []
    batches = [[("idle", 0, 1), ("idle", 1, 2), ("busy", 2, 3)], [("busy", 300, 4), ("idle", 290, 5)], [("busy", 2000, 6)],
               [("idle", 1, 7), ("idle", 1990, 8), ("busy", 2001, 9), ("busy", 2002, 10)]]
    for batch in batches:
        spark.createDataFrame([(k, start + timedelta(seconds=s), e) for k, s, e in batch], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = (
            rate_cap_stream(stream, "k", "ts", "e", 2, 60, "5 minutes").writeStream.outputMode("append")
            .foreachBatch(lambda frame, _: got.update({r.e: r.accepted for r in frame.collect()}))
            .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        assert query.exception() is None
        values = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint")).option("stateVarName", "recent").load()
        kept.append(sorted({r.key.name for r in values.collect()}))
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False, 8: True, 9: True, 10: False}
    assert kept == [["busy", "idle"], ["busy", "idle"], ["busy"], ["busy", "idle"]]


def test_a_batch_reads_its_payloads_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [(f"p{i}", "remotive", '{"jobs": [{"id": %d, "title": "A"}]}' % i if i % 2 else "<p>x</p>") for i in range(6)]
    payloads = payload_table(spark.createDataFrame(rows, "payload_id string, source string, body string"))
    body = F.udf(read, "string").asNondeterministic()("body")
    table = JobTable(spark, str(tmp_path))
    ingest_into(table, payloads.withColumn("body", body), datetime(2026, 3, 22, tzinfo=timezone.utc), "b1")
    assert seen.value == 6 and table.read().count() == 3
