"""What keeps the work of a task and the rows that travel bounded."""

import time
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from joblode.operators import upsert
from joblode.operators.closure import linked_groups
from joblode.operators.replay import RECORD
from joblode.plans import listing_view as view
from joblode.schemas import JOB_FIELDS, ORDER_COLUMNS
from joblode.session import CLEANUP_CONF
from joblode.sources import derived, store
from joblode.sources.store import JobTable

SF_DIR = "/root/testdata/sf0.001"
T1 = datetime(2026, 3, 22, 9, 0, tzinfo=timezone.utc)
T2 = datetime(2026, 3, 23, 9, 0, tzinfo=timezone.utc)
tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables not present")


@pytest.fixture
def batch(spark):
    rows = [(f"j{i}", f"u{i}" if i % 3 else None, f"t{i}", 0, "p", i) for i in range(30)]
    made = spark.createDataFrame(rows, "id string, source_job_url string, title string, src_rank int, payload_id string, pos long")
    kinds = {"skills": "array<string>", "posted_at": "timestamp", "freshness_days": "int"}
    rest = {name: F.lit(None).cast(kinds.get(name, "string")) for name in JOB_FIELDS if name not in made.columns}
    return made.withColumns(rest)


@tables
def test_a_task_gets_so_many_listings(spark, monkeypatch):
    monkeypatch.setattr(view, "TASK_ROWS", 250)
    sizes = view.listing_rows(spark, SF_DIR).groupBy(F.spark_partition_id()).count().collect()
    assert max(row["count"] for row in sizes) < 400 and sum(row["count"] for row in sizes) == view.table(spark, SF_DIR, "lineitem").count()


@tables
def test_long_generated_methods_are_not_run_by_the_interpreter(spark):
    driver.queries()["norm_time"](spark, SF_DIR)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_first_batch_joins_nothing_stored(spark, batch, tmp_path):
    table = JobTable(spark, str(tmp_path))
    stored, urls = table._around(None, batch)
    plan = upsert.resolve(stored, batch, urls)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_records_are_settled_without_their_payload(spark, batch, tmp_path):
    table = JobTable(spark, str(tmp_path))
    numbered = table.staged(batch.select(*JOB_FIELDS, *ORDER_COLUMNS).withColumn(RECORD, F.monotonically_increasing_id()))
    settled = upsert.settle(*table._around(None, numbered), numbered.select(*upsert.RECORDS), T1, table.staged)
    assert set(settled.columns) == {*upsert.RECORDS, "target", "identity"}
    got, want = upsert.reduce_settled(settled, numbered), upsert.reduce_batch(settled.join(numbered.drop("id", "source_job_url", *ORDER_COLUMNS), RECORD).drop(RECORD))
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() == 30


def test_postings_share_a_row_for_many_jobs(spark):
    ids = [f"id-of-some-length-{i}" for i in range(640)]
    fields = {name: F.lit("the same words in every one") for name in ("title", "location_raw", "company")}
    nothing = {name: F.lit(None).cast("string") for name in ("normalized_title", "description_snippet", "location_city", "location_country")}
    rows = spark.createDataFrame([(i % 3, key) for i, key in enumerate(ids)], "bucket int, id string").coalesce(1)
    rows = rows.withColumns({**fields, **nothing, "skills": F.array().cast("array<string>")})
    held = derived.postings(rows)
    assert held.count() < 640 * 10  # a row for each trigram of each job would be some 50 for each
    assert sorted(r.id for r in derived.meeting(held, ["tsam", "twor"]).collect()) == sorted(ids)
    assert derived.meeting(held, ["tsam", "tzzz"]).count() == 0


def test_rounds_of_a_long_chain_leave_one_table(spark, tmp_path):
    table = JobTable(spark, str(tmp_path))
    chain = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = linked_groups(chain, table.staged, table.unstaged)
    assert found.where("group <> 0").isEmpty() and found.count() == 101
    assert len(list((tmp_path / "staging").iterdir())) == 1


@tables
def test_joins_that_shuffle_do_not_undo_the_dealing(spark, monkeypatch):
    monkeypatch.setattr(view, "TASK_ROWS", 250)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = view.listing_rows(spark, SF_DIR)
        sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert max(row["count"] for row in sizes) < 400
    monkeypatch.undo()
    assert sorted(rows.collect()) == sorted(view.listing_rows(spark, SF_DIR).collect())


@tables
@pytest.mark.parametrize("name", ["response_matches", "ranked_list_resolve", "insert_branch", "skills_gap", "missing_skills"])
def test_listings_that_are_used_twice_are_normalized_once(spark, name):
    plan = driver.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def _shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(file.name.startswith("shuffle_") for folder in folders for file in Path(folder.getPath()).rglob("*"))


def _settles(spark, wanted):
    for _ in range(50):
        if _shuffle_files(spark) <= wanted:
            return True
        time.sleep(0.2)
    return False


def test_writes_leave_no_shuffle_files(spark, batch, tmp_path):
    before, conf = _shuffle_files(spark), spark.conf.get(CLEANUP_CONF)
    counted = batch.repartition(3, "title").groupBy("title").count()
    saved = JobTable(spark, str(tmp_path)).staged(counted)
    assert _settles(spark, before) and spark.conf.get(CLEANUP_CONF) == conf
    assert sorted(saved.collect()) == sorted(counted.collect())


def test_a_merge_in_steps_leaves_the_same_table(spark, batch, tmp_path, monkeypatch):
    moved = batch.withColumns({"title": F.concat(F.lit("new "), "title"), "pos": F.col("pos") + 100}).where("pos % 2 = 0")
    lost = batch.withColumns({"id": F.lit(None).cast("string"), "source_job_url": F.lit(None).cast("string"), "pos": F.col("pos") + 200}).limit(1)
    found = {}
    for name, step_bytes in {"one": 1 << 30, "many": 1}.items():
        monkeypatch.setattr(store, "STEP_BYTES", step_bytes)
        table = JobTable(spark, f"{tmp_path}/{name}", buckets=4, keep=(derived.NAMES,))
        for rows, day in ((batch, T1), (moved.unionByName(lost), T2)):
            persisted = table.upsert(rows, day)
            assert persisted.count() == rows.count()
            table.unstaged(persisted)
        assert not [*(tmp_path / name / "staging").glob("*/**/*.parquet")]
        found[name] = (sorted(map(str, table.read().collect())), sorted(map(str, table.top("companies", 5).collect())))
    assert found["one"] == found["many"] and len(found["one"][0]) == 31
    assert len([*(tmp_path / "many" / "data").iterdir()]) > len([*(tmp_path / "one" / "data").iterdir()]) == 2


def test_a_merge_keeps_the_bucket_of_records_without_an_id(spark, batch, tmp_path):
    table = JobTable(spark, str(tmp_path))
    table.commit(upsert.apply_reduced(table._empty_like(batch), upsert.reduce_batch(upsert.resolve(table._empty_like(batch), batch)), T1, 1), T1)
    lost = batch.withColumns({"id": F.when(F.col("pos") > 0, F.col("id")), "source_job_url": F.lit(None).cast("string")}).limit(2)
    table.upsert(lost, T2)
    assert {row.id for row in table.read().collect()} == {None, *(f"j{i}" for i in range(30))}
