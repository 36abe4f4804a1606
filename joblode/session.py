"""Session helpers: a local session for tests and the benchmark, the shared folder, code for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: HotSpot never compiles a longer method. A generated stage above it runs in the bytecode interpreter; with this limit
#: Spark runs its operators one by one instead, in small methods.
METHOD_LIMIT = {"spark.sql.codegen.hugeMethodLimit": "8000"}
CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of a statement when it ends, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings the library expects on a cluster too (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("joblode")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="joblode-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names for cut lineage; a folder of the warehouse where it names none."""
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_joblode").rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For writes whose rows are read from the written files alone: their shuffle files go when the write ends.

    They would stay for as long as the driver has room in its heap, so the disk would hold the shuffles of all steps at once.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_CONF)
        else:
            spark.conf.set(CLEANUP_CONF, before)


def save(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Write rows for the steps that follow, closely packed, in folders of a column if one is named."""
    with shuffles_dropped(rows.sparkSession):
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(path)


def written(name: str, rows: DataFrame) -> DataFrame:
    """Rows that are used more than once: computed once, written to the shared folder and read again."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    save(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="joblode-")) / "joblode.zip"
    with zipfile.ZipFile(archive, "w") as package:
        for file in PACKAGE.rglob("*.py"):
            package.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
