"""Near-duplicate embeddings: p-stable hashing for the Euclidean distance, then exact cosines.

Vectors are scaled to length one. A table rounds PROJECTIONS(n) random Gaussian projections, shifted and divided by
WIDTH, to integers and hashes them. The number of projections grows with the logarithm of the row count, so that
unrelated vectors rarely meet, as long as MAX_TABLES tables do; the number of tables follows from it, so that a pair at the threshold is missed with a
probability of MISS at most. Every pair that meets is held against the cosine in double precision, once.

Equal vectors are one item with a count. Vectors that are null, empty, zero or hold null or non-finite components link
with nothing; so do rows with a null id (component_id null). Vectors of different length never link. Rows that repeat
an id with other vectors are rows of their own that share their id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.buckets import links, numbered, smallest_ids
from joblode.llm.common import attach, quoted, staged

WIDTH = 2.0
MISS = 1e-3
UNRELATED = math.sqrt(2.0)
MAX_TABLES = 400


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at this distance fall into one cell of a projection."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Projections for each table and tables: about one unrelated row in ten meets a row in a table.

    Where that takes more than MAX_TABLES tables, fewer projections: more rows meet, no more pairs are missed.
    """
    k = max(4, math.ceil(math.log(10 * max(rows, 10)) / -math.log(collision(UNRELATED))))
    near = collision(math.sqrt(max(0.0, 2 - 2 * threshold)))
    needed = lambda k: 1 if near**k >= 1 else math.ceil(math.log(MISS) / math.log1p(-(near**k)))
    while k > 1 and needed(k) > MAX_TABLES:
        k -= 1
    tables = needed(k)
    return k, tables


def _unit(values: list[list | None]) -> list[np.ndarray | None]:
    out = []
    for v in values:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.asarray(v, np.float64)
        top = 0.0 if x is None or not np.isfinite(x).all() else np.abs(x).max()
        if not top:
            out.append(None)
            continue
        x = x / top
        out.append(x / np.sqrt(x @ x) + 0.0)
    return out


def _judge(threshold: float):
    def prepare(frame: pd.DataFrame):
        vectors = [np.frombuffer(v, np.float64) for v in frame["unit"]]
        dims = np.array([len(v) for v in vectors])
        padded = np.zeros((len(vectors), dims.max()))
        for row, v in zip(padded, vectors, strict=True):
            row[: len(v)] = v

        def ask(a: np.ndarray, b: np.ndarray, open_: np.ndarray) -> np.ndarray:
            return open_ & (padded[a] @ padded[b].T >= threshold) & (dims[a][:, None] == dims[b][None, :])

        return ask

    return prepare


def find_near(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 7) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept, linkable."""
    rows = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(embedding).cast("array<double>").alias("v"))
    k, tables = plan(rows.count(), threshold)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        mixer = np.random.default_rng(seed).integers(1, 2**62, size=k, dtype=np.int64) | 1
        for batch in batches:
            units = _unit(batch.column("v").to_pylist())
            ids = batch.column("vec_id").to_pylist()
            hashes: list = [None] * len(ids)
            for dim in {len(u) for u in units if u is not None}:
                if dim not in bases:
                    draw = np.random.default_rng([seed, dim])
                    bases[dim] = draw.standard_normal((dim, tables * k)), draw.uniform(0, WIDTH, tables * k)
                at = [i for i, u in enumerate(units) if u is not None and len(u) == dim]
                cells = np.floor((np.stack([units[i] for i in at]) @ bases[dim][0] + bases[dim][1]) / WIDTH).astype(np.int64)
                mixed = (cells.reshape(len(at), tables, k) * mixer).sum(2) + dim
                for i, h in zip(at, mixed, strict=True):
                    hashes[i] = h.tolist()
            raw = [None if u is None else u.tobytes() for u in units]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([None if r is None else hashlib.sha256(r).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["vec_id", "key", "unit", "hashes"],
            )

    hashed = staged(rows.mapInArrow(project, "vec_id long, key binary, unit binary, hashes array<long>"), "vectors")
    good = hashed.where("key is not null and vec_id is not null")
    groups = good.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    # a row of items is a vector with its smallest id; ids may repeat, so items have numbers of their own
    items = numbered(
        good.join(groups.select(F.col("id").alias("vec_id"), "key", "n"), ["vec_id", "key"])
        .dropDuplicates(["vec_id", "key"]).select(F.col("vec_id").alias("own_id"), "key", "n", "unit", "hashes"),
        "items",
    )
    found = staged(links(items, items.select("id", "unit"), _judge(threshold)), "links")
    degree = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    known = staged(
        smallest_ids(items.select("id", "own_id", "key", "n"), found).join(degree, "id", "left")
        .select("key", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.col("smallest").alias("component_id")),
        "classes",
    )
    linked = attach(good.select("vec_id", "key"), known, "key", "n", hashed.count()).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.lit(True).alias("linkable")
    )
    alone = hashed.where("key is null or vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(False).alias("linkable")
    )
    return linked.unionByName(alone)
