"""WARC archives and their index: write pages, merge the index runs, read the archives back.

Of pages with equal payloads of at least REVISIT_BYTES the one with the largest id is written as a response record;
the others become revisit records that refer to it and carry its digest and length but no payload. Each task writes
gzip archives (one member for each record) under names of their own into the shared folder, and a run: the index rows
of the archive, sorted by URL key, capture time and id. The runs table is written by Spark, so only archives of
committed tasks are ever read; what a lost or repeated task left is never referred to.

The runs are cut into ranges of that order; a task merges the pieces of all runs in its range with a loser tree, so the
index comes out in global order, partition after partition, and no task holds more than about MERGE_ROWS rows. The
merged history is written with the place of each capture in it. Records are read back by this index alone: from the
archive, offset and length that it names, and a record that is not the one it announces stops the job.

Null html is an empty payload, a null url has no target and the empty key, a null page_id is the smallest id. Rows that
repeat an id and a payload are written one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblode.llm.common import attach, quoted, scratch, staged

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
MERGE_ROWS = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "file string, pos long, url_key string, captured long, page_id long, offset long, length long, record_type string, payload_digest string"
HISTORY = f"position long, {RUN}"
RECORD = (
    "position long, url_key string, file string, offset long, page_id long, url string, captured long, payload_bytes long, "
    "payload_digest string, record_type string, refers_to long"
)


def resolved(spark: SparkSession, folder: str) -> str:
    """A folder as a URI; without a scheme it lies on Spark's default file system, as for Spark's own readers."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    folder = re.sub(r"^file:/+", "/", folder)
    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", folder))


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and query: pages of a site sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.strip().lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record. refers_to: the id of the response for a revisit, which carries no payload."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {datetime.fromtimestamp(captured, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's page id, url, capture time, payload length and digest, type, and the id it refers to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    block = rest[:length]
    if not first.startswith("WARC/") or len(block) != length or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its digest")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
        "captured": int(datetime.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp()),
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
    }


def _revisits(pages: DataFrame, total: int) -> DataFrame:
    """page_id, digest and refers_to of the pages that repeat another one's payload."""
    keys = pages.where(F.col("bytes") >= REVISIT_BYTES)
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("size")).where("size > 1 and refers_to is not null")
    return attach(keys, staged(groups, "warc-groups"), "digest", "size", total).where("not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, captured: Column, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives and returns the runs: one row per record, sorted in each file, with its place (RUN).

    captured: seconds since 1970 (null: 0). archive_bytes: a new archive is begun after so many, uncompressed.
    """
    folder = resolved(pages.sparkSession, folder)
    payload = F.coalesce(quoted(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        quoted(page_id).cast("long").alias("page_id"), quoted(url).cast("string").alias("url"), F.coalesce(captured.cast("long"), F.lit(0)).alias("captured"),
        payload.alias("payload"), F.sha1(payload).alias("digest"),
    )
    keys = staged(rows.select("page_id", "digest", F.octet_length("payload").alias("bytes")), "warc-digests")
    revisits = staged(_revisits(keys, keys.count()), "warc-revisits")
    marked = rows.alias("r").join(
        revisits.alias("v"), F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.digest") == F.col("v.digest")), "left"
    ).select("r.page_id", "url", "captured", "payload", "r.digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        out, run, at = None, [], 0
        for batch in batches:
            for at_row in range(batch.num_rows):  # one payload in Python at a time
                row = {name: column[at_row].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
                if out is None:
                    name, run, at, raw = f"{uuid.uuid4().hex}.warc.gz", [], 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = record(row["page_id"], row["url"], row["captured"], row["payload"], row["digest"], row["refers_to"])
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = member.compress(data) + member.flush()
                out.write(packed)
                kind = "response" if row["refers_to"] is None else "revisit"
                run.append((url_key(row["url"]), row["captured"], row["page_id"], at, len(packed), kind, row["digest"]))
                at, raw = at + len(packed), raw + len(data)
                if raw >= archive_bytes:
                    out.close()
                    yield from _run(name, run)
                    out = None
        if out is not None:
            out.close()
            yield from _run(name, run)

    return staged(marked.mapInArrow(write, RUN), "warc-runs")


def _order(key: tuple) -> tuple:
    return key[0], key[1], (key[2] is not None, key[2] or 0)


def _run(name: str, run: list[tuple]) -> Iterator[pa.RecordBatch]:
    run = sorted(run, key=_order)
    columns = list(zip(*run, strict=True))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(run), pa.string()), pa.array(range(len(run)), pa.int64()), pa.array(columns[0], pa.string()),
            *(pa.array(c, pa.int64()) for c in columns[1:5]), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.string()),
        ],
        names=["file", "pos", "url_key", "captured", "page_id", "offset", "length", "record_type", "payload_digest"],
    )


def merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k-way merge of sorted runs of (key, row) by a loser tree: an inner node keeps the run that lost there."""
    k = len(runs)
    at = [0] * k
    heads = [(run[0][0], i) if run else None for i, run in enumerate(runs)]

    def beats(a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # a place not played yet lets the other climb
        return heads[b] is None or heads[a] is not None and heads[a] <= heads[b]

    losers = [-1] * max(k, 1)

    def climb(winner: int) -> int:
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
                if winner < 0:
                    return -1
            node //= 2
        return winner

    winner = -1
    for i in range(k):
        winner = climb(i)
    while winner >= 0 and heads[winner] is not None:
        yield runs[winner][at[winner]]
        at[winner] += 1
        heads[winner] = (runs[winner][at[winner]][0], winner) if at[winner] < len(runs[winner]) else None
        winner = climb(winner)


def capture_histories(runs: DataFrame) -> DataFrame:
    """The runs (RUN) merged: in global order of url_key, captured, page_id, partition after partition."""
    parts = max(1, -(-runs.count() // MERGE_ROWS))
    order = ["url_key", "captured", "page_id", "file", "pos"]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces.setdefault(row[0], []).append(((*_order(row[2:5]), row[0], row[1]), row))
        for piece in pieces.values():
            piece.sort(key=lambda x: x[1][1])  # places in the run; sorted already as a rule
        rows = []
        for _, row in merge(list(pieces.values())):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    return runs.repartitionByRange(parts, *order).mapInArrow(merged, RUN)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def numbered(history: DataFrame) -> DataFrame:
    """The merged history (HISTORY), each capture with its place from 1 on; written, so that the order is settled."""
    placed = staged(history.withColumn("at", F.monotonically_increasing_id()), "warc-history")
    part = F.shiftright("at", 33).alias("part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range of the merge
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("part", part).join(starts, "part").select((F.col("start") + within + 1).alias("position"), *history.columns)


def read_records(folder: str, index: DataFrame) -> DataFrame:
    """The records (RECORD) that an index (HISTORY) names; digests of payloads are checked.

    The rows of an archive go to one task in the order of their offsets, so it is read from front to back once.
    """
    folder = resolved(index.sparkSession, folder)
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in RECORD.split(", ")]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        stream, open_file, at, rows = None, None, 0, []
        for batch in batches:
            for entry in batch.to_pylist():  # index rows, without payloads
                if entry["file"] != open_file:
                    if stream is not None:
                        stream.close()
                    stream, open_file, at = store.open_input_stream(f"{base}/{entry['file']}", compression=None, buffer_size=1 << 20), entry["file"], 0
                while at < entry["offset"]:
                    skipped = len(stream.read(min(1 << 20, entry["offset"] - at)))
                    if not skipped:
                        raise ValueError("the archive ends before the offset")
                    at += skipped
                member = stream.read(entry["length"])
                at += len(member)
                found = parse(_unpacked(member, entry["length"]))
                for name in ("page_id", "captured", "record_type", "payload_digest"):
                    if found[name] != entry[name]:
                        raise ValueError(f"the index announces another {name}")
                rows.append({name: entry[name] for name in ("position", "url_key", "file", "offset")} | found)
                if len(rows) == 4096:
                    yield packed(rows)
                    rows = []
        if stream is not None:
            stream.close()
        if rows:
            yield packed(rows)

    archives = max(1, index.select("file").distinct().count())
    return index.repartition(archives, "file").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def _unpacked(member: bytes, length: int) -> bytes:
    unzip = zlib.decompressobj(31)
    try:
        data = unzip.decompress(member)
    except zlib.error as error:
        raise ValueError("the place in the index is not the start of a record") from error
    if len(member) != length or not unzip.eof or unzip.unused_data:
        raise ValueError("the place in the index is not one whole record")
    return data


def round_trip(pages: DataFrame, captured: Column, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write, merge, read back through the merged index: the records with their place in the capture history."""
    folder = scratch(pages.sparkSession, "warc")
    runs = write_archives(pages, folder, captured, page_id, url, html, archive_bytes)
    return read_records(folder, staged(numbered(capture_histories(runs)), "warc-index"))
