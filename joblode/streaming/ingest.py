"""Continuous ingest of landed payload files into the job table."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from joblode import lexicon
from joblode.operators.ingest import ingest_into
from joblode.sources.landing import scan_landing
from joblode.sources.store import JobTable


def _now() -> datetime:
    return datetime.now(tz=timezone.utc)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint gives its stream, the same after a restart."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first().value)["id"]


def start_ingest(
    spark: SparkSession,
    landing: str,
    table: JobTable,
    checkpoint: str,
    clock: Callable[[], datetime] = _now,
    name: str = "listing-ingest",
    sources: list[tuple] = lexicon.SOURCES,
    available_now: bool = False,
) -> StreamingQuery:
    """Every trigger takes the new files through parse, dedupe, normalize and upsert.

    The commit log keeps the batch id, so a batch that is replayed after a failure changes nothing. The id
    is made of the one that the checkpoint keeps and the epoch: epochs start again with a new checkpoint.
    """

    def merge(payloads: DataFrame, epoch: int) -> None:
        batch_id = f"{stream_id(spark, checkpoint)}-{epoch}"
        if not table.has_batch(batch_id):
            ingest_into(table, payloads, clock(), batch_id)

    stream = scan_landing(spark, landing, sources, streaming=True)
    writer = stream.writeStream.queryName(name).foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
