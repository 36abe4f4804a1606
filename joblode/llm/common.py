"""What the operators of this subpackage share: staged tables, joins with hot keys, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.session import shared_folder

HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_prefix(df: DataFrame, *names: str) -> str:
    """The shortest prefix of underscores under which df has none of the names, whatever its case."""
    taken, prefix = {c.lower() for c in df.columns}, ""
    while any(f"{prefix}{name}".lower() in taken for name in names):
        prefix += "_"
    return prefix


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with their group. groups: one row for each key, size: the rows of that key.

    Keys with more than 1/HOT_KEYS of all rows are at most HOT_KEYS, so their groups are broadcast and their
    rows stay where they are; for the others a task gets at most that share of a key.
    """
    limit = max(1, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    near = rows.join(hot, key)
    far = rows.join(hot.select(key), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def components(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (long ids): columns node, component (the smallest node reachable).

    Large-star and small-star steps: each links the neighbours of a node to the smallest of them, until every
    edge leads to a smallest node. Minima combine on the map side, hubs go through attach(), and each round is
    a staged table.
    """
    pairs = staged(
        edges.select(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi"))
        .where("lo < hi").distinct(), "edges",
    )
    for _ in range(rounds):
        large = _star(pairs.union(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))), larger=True)
        large = staged(large, "large-star")
        small = staged(_star(large.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")), larger=False), "small-star")
        done = (
            small.join(small.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").isEmpty()
            and small.groupBy("hi").count().where("count > 1").isEmpty()
        )
        pairs = small
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return staged(pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots), "components")


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """links: node lo with neighbour hi. Link neighbours (the larger ones, or all with the node) to the smallest."""
    links = links.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    minima = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    total = links.count()
    joined = attach(links, minima.withColumn("m", F.least("u", "m")), "u", "n", total)
    if larger:
        out = joined.where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
    else:
        out = joined.select(F.col("m").alias("lo"), F.col("v").alias("hi")).union(
            minima.select(F.least("u", "m").alias("lo"), F.col("u").alias("hi"))
        )
    return out.where("lo < hi").distinct()


def doc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def with_columns_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(quoted(c) for c in columns))
