"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Rows with equal texts are a group and stay together, unless the group alone exceeds a shard's share of one of the
three measures; such a group is dealt into pieces of half a share, because shards of near equal size cannot hold it. Small
groups are bundled by hash into at most BUNDLES bundles, so the packer sees a bounded number of items whatever the
input. Items go, largest first, to the shard where the dot product of the item with the shard's residual capacity is
highest. Then the fullest and the emptiest shard exchange items until the bytes of all shards lie within TOLERANCE
of a share or no exchange brings them closer, and after that, within these bounds, tokens and rows in the same way;
the sizes come out near equal (law `bytes`).

Within an item rows are numbered in order of id; large items are cut into cells of equal hash range first, so no task
sorts more than a few times the rows of an average bundle. The offsets of items and cells make the slots of a shard gapless.

Null text counts as empty; a null id sorts first. Rows that repeat an id and a text get slots of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblode.llm.common import quoted, staged
from joblode.llm.mixing import token_count

OVERHEAD = 16
BUNDLES = 16384
TOLERANCE = 0.01
NEAR = 16
MEASURES = ("size", "tokens", "ones")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of measures), largest first, by the dot product with the residual capacity."""
    total = items.sum(0)
    scaled = items / np.where(total > 0, total, 1)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -scaled.max(1))):
        out[i] = np.argmax(residual @ scaled[i])
        residual[out[i]] -= scaled[i]
    return out


def exchange(items: np.ndarray, where: np.ndarray, shards: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """`where` after moves between the fullest and the emptiest shard, first of the first measure (bytes), then of the others.

    An item moves alone or against one of the NEAR items of the other shard whose bytes are nearest to half the gap less;
    of the moves that bring the first measure closer (later: that keep it within half the tolerance of a share) the one
    that leaves the two shards most even in all measures is taken. Each move lowers a sum of squares, so the exchange ends.
    """
    where, total = where.copy(), items.sum(0)
    if shards < 2 or total[0] <= 0:
        return where
    scaled = items / np.where(total > 0, total, 1)
    load = np.stack([np.bincount(where, scaled[:, m], shards) for m in range(items.shape[1])], 1)
    for m in range(items.shape[1]):
        stuck = np.zeros(shards, bool)  # fullest shards that no move helps, as one that a single item overfills
        while not stuck.all():
            full, slack = int(np.where(stuck, -np.inf, load[:, m]).argmax()), int(load[:, m].argmin())
            gap = load[full] - load[slack]
            if gap[m] <= tolerance / shards:
                break
            ours, theirs = np.nonzero(where == full)[0], np.nonzero(where == slack)[0]
            theirs = theirs[np.argsort(scaled[theirs, 0], kind="stable")]
            sizes = scaled[theirs, 0]
            at = np.searchsorted(sizes, scaled[ours, 0] - gap[0] / 2)
            near = [at + k for k in range(-NEAR // 2, NEAR // 2)] if len(theirs) else []
            take = np.concatenate([np.full(len(ours), -1), *(np.clip(k, 0, len(theirs) - 1) for k in near)])
            give = np.tile(ours, len(near) + 1)
            delta = scaled[give] - np.concatenate([scaled[theirs], np.zeros((1, items.shape[1]))])[take]
            if m == 0:
                useful = (delta[:, 0] > gap[0] * 1e-3) & (delta[:, 0] < gap[0] * (1 - 1e-3))
            else:
                after = np.abs(np.stack([load[full, 0] - delta[:, 0], load[slack, 0] + delta[:, 0]]) - 1 / shards).max(0)
                bound = max(tolerance / 2 / shards, abs(load[[full, slack], 0] - 1 / shards).max())
                squares = (delta * (delta - gap)).sum(1)  # half of how the two shards' sum of squares changes
                useful = (after <= bound) & (delta[:, m] > gap[m] * 1e-3) & (squares < -1e-6 / shards**2)
            if not useful.any():
                stuck[full] = True
                continue
            give, take, delta = give[useful], take[useful], delta[useful]
            k = int((delta * (delta - gap)).sum(1).argmin())
            load[full] -= delta[k]
            load[slack] += delta[k]
            where[give[k]] = slack
            if take[k] >= 0:
                where[theirs[take[k]]] = full
    return where


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", bundles: int = BUNDLES) -> DataFrame:
    """One row per row of docs: doc_id, size, tokens, text_crc32, law, shard, slot, grown_shard (null for this law)."""
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    rows = staged(
        docs.select(
            quoted(doc_id).cast("long").alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            token_count(text).alias("tokens"), F.crc32(body.cast("binary")).alias("text_crc32"), F.md5(body.cast("binary")).alias("text_key"),
            F.coalesce(quoted(doc_id).cast("long"), F.monotonically_increasing_id()).alias("spread"),  # fixed by staging
        ),
        "shard-rows",
    )
    sums = rows.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("size", "tokens")), F.count("*").alias("ones")).first()
    share = {m: max(1.0, sums[m] / shards) for m in MEASURES}
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("ones"))
    over = F.greatest(*(F.col(m) / share[m] for m in MEASURES))
    pieces = F.when(over > 1, F.ceil(2 * over)).otherwise(1).cast("long")
    # a group over a shard's share in some measure: at most 3 * shards of them
    large = F.broadcast(staged(groups.withColumn("pieces", pieces).where("pieces > 1").select("text_key", "pieces"), "shard-large"))
    piece = F.pmod(F.xxhash64("spread", F.lit("piece")), F.col("pieces"))
    small = F.concat(F.lit("b"), F.pmod(F.xxhash64("text_key"), F.lit(bundles)).cast("string"))
    items = rows.join(large, "text_key", "left").withColumn(
        "item", F.when(F.col("pieces").isNull(), small).otherwise(F.concat(F.lit("g"), "text_key", F.lit("-"), piece.cast("string")))
    )
    per_cell = max(1, -(-sums["ones"] // bundles)) * 4
    measured = items.groupBy("item").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("ones")).toPandas().sort_values("item", ignore_index=True)
    sizes = measured[list(MEASURES)].to_numpy(float)
    measured["shard"] = exchange(sizes, pack(sizes, shards), shards) if len(measured) else []
    measured["cells"] = -(-measured["ones"] // per_cell)
    spark = docs.sparkSession
    placed = F.broadcast(spark.createDataFrame(pd.DataFrame({c: measured[c] for c in ("item", "shard", "cells")}) if len(measured) else [], "item string, shard long, cells long"))
    placed_rows = staged(
        items.join(placed, "item").withColumn("cell", F.pmod(F.xxhash64("spread", F.lit("cell")), F.col("cells")))
        .select("doc_id", "size", "tokens", "text_crc32", "shard", "item", "cell"),
        "shard-items",
    )
    # one row for each item and cell: at most the items and total / per_cell more
    fill = placed_rows.groupBy("shard", "item", "cell").count()
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, 0)
    offsets = fill.withColumn("offset", F.sum("count").over(before) - F.col("count")).select("item", "cell", "offset")
    within = Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32")
    numbered = placed_rows.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(offsets), ["item", "cell"])
    return numbered.select(
        "doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> None:
    """docs as Parquet, one folder for each shard. Rows that repeat an id go where the id's smallest shard is."""
    where = shard(docs, shards, doc_id, text).groupBy("doc_id").agg(F.min("shard").alias("shard")).withColumnRenamed("doc_id", "__id")
    docs.join(where, quoted(doc_id).cast("long").eqNullSafe(F.col("__id")), "left").drop("__id").write.partitionBy("shard").parquet(path)
