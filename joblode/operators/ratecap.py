"""Trailing-window cap per key: which events would have been let through.

Each admission depends on the ones before it, so a key is a chain. The events are put in one global order (key, time,
id) and cut into chunks of about equal size by range, wherever that falls: a busy key spans many chunks, and no task
reads more than a chunk at a time. All chunks are scanned at once as if nothing came before them. Then those that
begin inside a key are scanned again from the state with which the chunk before them ended, until no such state changes
any more. A key that ever pauses for a window, or whose admissions fall in step again, is settled by the second scan; one
that never does costs one more scan of a chunk for each chunk it spans.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.session import shared_folder

CHUNK_EVENTS = 500_000


def admit(times: np.ndarray, recent: deque, limit: int, window: int) -> np.ndarray:
    """Flags for sorted event times; `recent` holds the last admitted times and is carried on.

    An event passes while fewer than `limit` admitted ones are younger than the window. Once the limit
    is reached nothing passes until the oldest of them ages out, so the scan jumps there directly.
    """
    passed = np.zeros(len(times), dtype=bool)
    at = 0
    while at < len(times):
        if len(recent) == limit:
            at += int(np.searchsorted(times[at:], recent[0] + window, side="left"))
            if at >= len(times):
                break
            recent.popleft()
        passed[at] = True
        recent.append(int(times[at]))
        at += 1
    return passed


def scan_chunks(limit: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of chunk and place (chunk, run, key, at, event_id, carry) -> flags, and a last row for each chunk
    with the times that are still counted at its end (event columns null, state set)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = run = None
        recent: deque = deque()
        for batch in batches:
            chunks, runs, times = (batch.column(name).to_numpy() for name in ("chunk", "run", "at"))
            cuts = np.flatnonzero((chunks[1:] != chunks[:-1]) | (runs[1:] != runs[:-1])) + 1
            edges = [0, *cuts.tolist(), len(runs)] if len(runs) else [0]
            flags = np.zeros(len(runs), bool)
            ended = []
            for start, end in zip(edges, edges[1:], strict=False):
                if chunks[start] != chunk:
                    if chunk is not None:
                        ended.append((chunk, run, list(recent)))
                    chunk, run = int(chunks[start]), int(runs[start])
                    recent = deque(batch.column("carry")[start].as_py() or [])
                elif runs[start] != run:
                    run, recent = int(runs[start]), deque()
                flags[start:end] = admit(times[start:end], recent, limit, window)
            yield _flagged(batch, flags, ended)
        if chunk is not None:
            yield _flagged(batch.slice(0, 0), np.zeros(0, bool), [(chunk, run, list(recent))])

    return scan


def _flagged(batch: pa.RecordBatch, flags: np.ndarray, ended: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    blank = {name: pa.nulls(len(ended), batch.schema.field(name).type) for name in ("key", "at", "event_id")}
    chunk, run, state = (list(x) for x in zip(*ended, strict=True)) if ended else ([], [], [])
    states = pa.concat_arrays([pa.nulls(len(flags), pa.list_(pa.int64())), pa.array(state, pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(batch.column("chunk").to_numpy(), pa.int32()), pa.array(chunk, pa.int32())]),
        pa.concat_arrays([pa.array(batch.column("run").to_numpy(), pa.int64()), pa.array(run, pa.int64())]),
        *(pa.concat_arrays([batch.column(name), blank[name]]) for name in blank),
        pa.concat_arrays([pa.array(flags, pa.bool_()), pa.nulls(len(ended), pa.bool_())]), states,
    ], names=["chunk", "run", "key", "at", "event_id", "accepted", "state"])


def rate_cap(
    events: DataFrame, key: str, ts: str, event_id: str, limit: int, window_seconds: float, chunk_events: int = CHUNK_EVENTS
) -> DataFrame:
    """(key, ts, event_id, accepted) under the given column names, one row per event.

    Events without a key share one; events without a time are not accepted. Events of one time pass in order of
    their ids. Four narrow columns go through the computation; a task remembers `limit` times.
    """
    if limit < 1 or window_seconds <= 0:
        raise ValueError("limit and window_seconds must be positive")
    spark = events.sparkSession
    folder = f"{shared_folder(spark)}/ratecap-{uuid4().hex}"
    window = int(round(window_seconds * 1_000_000))
    stamps = events.select(
        F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(event_id).alias("event_id")
    )
    timed = stamps.filter("at IS NOT NULL").withColumn("run", F.xxhash64(F.col("key").isNull(), "key"))
    place = ["run", "key", "at", "event_id"]
    chunks = max(-(-timed.count() // chunk_events), int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = timed.repartitionByRange(chunks, *place).withColumn("chunk", F.spark_partition_id())
    placed.write.parquet(f"{folder}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{folder}/placed")
    kinds = {field.name: field.dataType.simpleString() for field in placed.schema.fields}
    schema = f"chunk int, run bigint, key {kinds['key']}, at bigint, event_id {kinds['event_id']}, accepted boolean, state array<bigint>"

    def scanned(rows: DataFrame, step: int) -> None:
        lined_up = rows.repartition("chunk").sortWithinPartitions("chunk", *place).select("chunk", "run", "key", "at", "event_id", "carry")
        flags = lined_up.mapInArrow(scan_chunks(limit, window), schema)
        flags.write.parquet(f"{folder}/flags/step={step}")

    def flags() -> DataFrame:
        return spark.read.schema(f"{schema}, step int").parquet(f"{folder}/flags")

    nothing = F.array().cast("array<bigint>")
    begins = placed.groupBy("chunk").agg(F.min("run").alias("first"), F.max("run").alias("last"))
    begins.write.parquet(f"{folder}/begins")
    begins = spark.read.schema(begins.schema).parquet(f"{folder}/begins")
    used = begins.select("chunk", nothing.alias("carry"))
    scanned(placed.withColumn("carry", nothing), 0)
    step = 0
    while True:
        ends = flags().where("state IS NOT NULL").groupBy("chunk").agg(F.max_by(F.struct("run", "state"), "step").alias("end"))
        # range bounds are values of the data, so no chunk but the last can be empty
        order = ends.select((F.col("chunk") + 1).alias("chunk"), F.col("end.run").alias("run"), F.col("end.state").alias("state"))
        carry = begins.join(order, "chunk", "left").select(
            "chunk", F.when(F.col("run") == F.col("first"), F.col("state")).otherwise(nothing).alias("carry")
        ).withColumn("carry", F.coalesce("carry", nothing))
        stale = used.withColumnRenamed("carry", "was").join(carry, "chunk").where("carry <> was")
        step += 1
        if step > 1:  # from the second repetition on only chunks whose predecessor is settled
            stale = stale.join(stale.select((F.col("chunk") + 1).alias("chunk")), "chunk", "left_anti")
        stale.select("chunk", "carry").write.parquet(f"{folder}/stale/{step}")
        stale = spark.read.schema("chunk int, carry array<bigint>").parquet(f"{folder}/stale/{step}")
        if stale.isEmpty():
            break
        scanned(placed.join(stale, "chunk"), step)
        renewed = used.join(stale.select("chunk"), "chunk", "left_anti").unionByName(stale)
        renewed.write.parquet(f"{folder}/used/{step}")
        used = spark.read.schema("chunk int, carry array<bigint>").parquet(f"{folder}/used/{step}")

    found = flags().where("state IS NULL")
    latest = flags().where("state IS NOT NULL").groupBy("chunk").agg(F.max("step").alias("step"))
    untimed = stamps.filter("at IS NULL").select("key", "at", "event_id", F.lit(False).alias("accepted"))
    return found.join(latest, ["chunk", "step"], "left_semi").select("key", "at", "event_id", "accepted").unionByName(untimed).select(
        F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("event_id").alias(event_id), "accepted"
    )
