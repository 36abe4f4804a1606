"""Links between rows that share a hash bucket, found without listing the pairs of a bucket.

Items have an id and one hash for each table. Buckets with one member are dropped. A larger bucket is cut into blocks
of about BLOCK members; each pair of blocks is a unit of work, so a hot bucket spreads over many tasks. A pair of items
is judged only in the first table where both share a bucket. What leaves a task is linear in its rows: link counts and
a spanning forest of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblode.llm.common import attach, components, staged

BLOCK = 256
SHARD_ROWS = 1024

#: Called once for the rows of a task; gives a function (rows a, rows b, open pairs) -> linked pairs.
Judge = Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def links(items: DataFrame, payload: DataFrame, judge: Judge) -> DataFrame:
    """Rows (a, b, n): with b, an edge of the forest; without b, n more links of a.

    items: id long (of one row each, see numbered()), n long (rows it stands for), hashes array<long>. payload: id and whatever the judge reads.
    """
    members = items.select("id", F.posexplode("hashes").alias("t", "h")).select(
        "id", "t", F.xxhash64("t", "h").alias("bucket")
    )
    # near copies meet in many tables: of buckets with the same members the first is enough, and it is the
    # one where its pairs are judged
    marks = (F.bit_xor(F.xxhash64("id")).alias("mark"), F.bit_xor(F.xxhash64("id", F.lit("again"))).alias("mark2"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("t").alias("t"), *marks).where("size > 1")
    distinct = buckets.groupBy("size", "mark", "mark2").agg(F.min_by("bucket", F.struct("t", "bucket")).alias("bucket"))
    sizes = staged(distinct.select("bucket", "size"), "buckets")
    blocks = F.ceil(F.col("size") / BLOCK)
    work, total = sizes.agg(F.sum(F.col("size") * blocks), F.sum("size")).first()
    if not work:
        return items.sparkSession.createDataFrame([], "a long, b long, n long")
    shards = -(-int(work) // SHARD_ROWS)
    placed = attach(members, sizes, "bucket", "size", int(total)).withColumn("blocks", blocks)
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    units = placed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = units.select(
        "bucket", "t", "id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    ).withColumn("shard", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(shards)))
    rows = units.join(items.select("id", "n", "hashes").join(payload, "id"), "id")
    return rows.groupBy("shard").applyInPandas(lambda frame: _judged(frame, judge), "a long, b long, n long")


def numbered(items: DataFrame, what: str) -> DataFrame:
    """items, written with a number of their own as id."""
    return staged(items.withColumn("id", F.monotonically_increasing_id()), what)


def smallest_ids(items: DataFrame, found: DataFrame) -> DataFrame:
    """items(id, own_id, ...) with `smallest`: the smallest own_id of the rows that links lead to, itself included."""
    parts = components(found.where("b is not null")).withColumnRenamed("node", "id")
    linked = staged(items.join(parts, "id"), "linked").select(*items.columns, "component")
    least = linked.groupBy("component").agg(F.min("own_id").alias("smallest"), F.count("*").alias("members"))
    inside = attach(linked, staged(least, "smallest"), "component", "members", linked.count())
    alone = items.join(parts.select("id"), "id", "left_anti").withColumn("smallest", F.col("own_id"))
    return inside.select(*items.columns, "smallest").unionByName(alone)


def candidates(items: DataFrame) -> DataFrame:
    """Ids of items that share a bucket with another one.

    Both sides of the semi-join are dealt out by the join itself, so adaptive execution splits a hot bucket.
    """
    members = items.select("id", F.posexplode("hashes").alias("t", "h")).select("id", F.xxhash64("t", "h").alias("bucket"))
    shared = staged(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), "buckets")
    return members.join(shared, "bucket", "left_semi").select("id").distinct()


def _units(frame: pd.DataFrame) -> Iterator[np.ndarray]:
    keys = frame[["bucket", "lo", "hi"]].to_numpy()
    order = np.lexsort(keys.T)
    starts = np.nonzero(np.any(keys[order][1:] != keys[order][:-1], axis=1))[0] + 1
    yield from np.split(order, starts)


def _judged(frame: pd.DataFrame, judge: Judge) -> pd.DataFrame:
    ask, ids, n = judge(frame), frame["id"].to_numpy(), frame["n"].to_numpy()
    hashes = np.stack(frame["hashes"].to_numpy())
    table, block, lo, hi = (frame[c].to_numpy() for c in ("t", "block", "lo", "hi"))
    edges, counts = [], []
    for rows in _units(frame):
        first = rows[0]
        same = lo[first] == hi[first]
        a = rows if same else rows[block[rows] == lo[first]]
        b = rows if same else rows[block[rows] == hi[first]]
        if not len(a) or not len(b):
            continue
        open_ = np.triu(np.ones((len(a), len(b)), bool), 1) if same else np.ones((len(a), len(b)), bool)
        for s in range(table[first]):
            open_ &= hashes[a, s][:, None] != hashes[b, s][None, :]
        if not open_.any():
            continue
        linked = ask(a, b, open_)
        if not linked.any():
            continue
        counts += [(ids[a], linked @ n[b]), (ids[b], linked.T @ n[a])]
        nodes, roots = _forest(linked, same)
        both = ids[rows if same else np.concatenate([a, b])]
        edges.append((both[nodes], both[roots]))
    left = np.concatenate([x for x, _ in edges]) if edges else np.zeros(0, np.int64)
    right = np.concatenate([x for _, x in edges]) if edges else np.zeros(0, np.int64)
    many = pd.DataFrame({"a": left, "b": pd.array(right, "Int64"), "n": np.zeros(len(left), np.int64)})
    if not counts:
        return many
    degree = pd.DataFrame({"a": np.concatenate([x for x, _ in counts]), "n": np.concatenate([x for _, x in counts])})
    degree = degree[degree["n"] > 0].groupby("a", as_index=False)["n"].sum()
    degree["b"] = pd.array([None] * len(degree), "Int64")
    return pd.concat([many, degree[["a", "b", "n"]]], ignore_index=True)


def _forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, with that smallest node."""
    rows, columns = linked.shape
    far = rows + columns
    if same:
        linked = linked | linked.T
        left = right = np.arange(rows)
    else:
        left, right = np.arange(rows), rows + np.arange(columns)
    while True:
        new_right = np.minimum(right, np.where(linked, left[:, None], far).min(0))
        new_left = new_right if same else np.minimum(left, np.where(linked, new_right[None, :], far).min(1))
        if (new_left == left).all() and (new_right == right).all():
            break
        left, right = new_left, new_right
    label = left if same else np.concatenate([left, right])
    nodes = np.nonzero(label != np.arange(len(label)))[0]
    return nodes, label[nodes]
