"""A listing view over the driver tables: one SELECT that Spark SQL and DuckDB both run unchanged."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.operators.normalize import Wanted, normalize_listings

AS_OF = date(2026, 3, 22)

#: Listings that one task normalizes.
TASK_ROWS = 100_000

HOST_LETTERS = "m\u00fc\u00e7\u0131\u011f\u015f\u00f6a1\u00e4\u00df\u00f1\u00e9\u4e2d\u56fdb\u65e5\u672c\u043f\u0440\u0438\u0432\u0435\u0442c2\u6771\u4eac"

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

LISTING_SQL = """
SELECT
  lpad(CAST(l_orderkey AS STRING), 15, '0') || '-' || lpad(CAST(l_partkey AS STRING), 12, '0') || '-' ||
    lpad(CAST(l_suppkey AS STRING), 12, '0') || '-' || CAST(l_linenumber AS STRING) || '-' ||
    CAST(CAST(l_shipdate AS DATE) AS STRING) AS seq,
  l_orderkey AS order_key,
  CASE l_linenumber % 4 WHEN 0 THEN 'arbeitnow' WHEN 1 THEN 'remotive' WHEN 2 THEN 'themuse' ELSE 'kariyer' END AS source,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL
       ELSE CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS source_job_id,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL
       WHEN l_orderkey % 7 = 1 THEN 'HTTPS://Jobs.Example.com/p/' || CAST(l_partkey AS STRING) || '/#apply'
       WHEN l_orderkey % 7 = 2 THEN 'https://jobs.example.com/p/' || CAST(l_partkey AS STRING) || '/'
       ELSE 'https://jobs.example.com/p/' || CAST(l_partkey AS STRING) || '?s=' || CAST(l_suppkey AS STRING) END AS source_job_url,
  CASE l_partkey % 8 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'jr. ' WHEN 2 THEN 'LEAD ' WHEN 3 THEN 'Vice President '
         WHEN 4 THEN '' WHEN 5 THEN 'Sr.Remote ' WHEN 6 THEN 'Jr.Contract ' ELSE 'Mid-level ' END
    || CASE l_suppkey % 4 WHEN 0 THEN 'python API engineer' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Yazılım Geliştirici' ELSE 'QA of Java systems' END
    || CASE l_linenumber % 3 WHEN 0 THEN ' (Remote, Full-time)' WHEN 1 THEN ' | Contract' ELSE '' END AS title,
  s_name AS company,
  CASE WHEN l_partkey % 5 = 0 THEN 'Remote' WHEN l_partkey % 5 = 1 THEN n_name
       WHEN l_suppkey % 9 = 0 THEN 'Istanbul, Turkey' WHEN l_suppkey % 9 = 1 THEN 'Izmir, Türkiye'
       WHEN l_suppkey % 9 = 2 THEN 'Ankara, TR' ELSE n_name || ', ' || r_name END AS location_raw,
  CASE WHEN l_orderkey % 11 = 0 THEN 'not-a-date' WHEN l_orderkey % 11 = 1 THEN '1774000000'
       ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) || 'T08:00:00+02:00' END AS posted_at_raw,
  'Work with ' || p_name || ', ' || CASE l_orderkey % 5 WHEN 0 THEN 'K8s and Postgres' WHEN 1 THEN 'Node.js and TS'
       WHEN 2 THEN 'AWS, Docker, SQL' WHEN 3 THEN 'golang or Rust' ELSE 'spreadsheets' END || '.' AS description_text,
  CASE l_suppkey % 3 WHEN 0 THEN 'Python,K8s,remote' WHEN 1 THEN 'SQL, Tableau' ELSE '' END AS tags_csv,
  CASE l_partkey % 13 WHEN 0 THEN 'full_time' WHEN 1 THEN 'Part time' WHEN 2 THEN 'fixed term' WHEN 3 THEN 'internship' END AS employment_type_raw,
  CASE l_suppkey % 7 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN 'Remote-first' END AS remote_type_raw
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def register(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> None:
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare view, columns as in LISTING_SQL.

    Rows are dealt out evenly before texts are made: what follows costs some hundred times as much for a
    row as this shuffle, so it must not depend on how the files happen to be cut. Parts are cut by rows, not
    by bytes: 64 MB of these columns are millions of listings, more than a task can sort in memory. They are cut behind
    the joins: parts and suppliers of large tables are not broadcast, and the shuffle of such a join would put the rows
    into a few large parts again. Few rows are left to Spark, which cuts them into a part for each core.
    """
    register(spark, sf_dir, ["part", "supplier", "nation", "region"])
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").select(*columns)
    parts = -(-lines.count() // TASK_ROWS)
    if parts > spark.sparkContext.defaultParallelism:
        lines.createOrReplaceTempView("lineitem")
        made, joined = LISTING_SQL.split("\nFROM ")
        needed = ", ".join([*columns, "p_name", "s_name", "n_name", "r_name"])
        spark.sql(f"SELECT {needed} FROM {joined}").repartition(parts).createOrReplaceTempView("listing_lines")
        return spark.sql(f"{made}\nFROM listing_lines")
    lines.hint("rebalance").createOrReplaceTempView("lineitem")
    return spark.sql(LISTING_SQL)


def csv_tags(csv: Column) -> Column:
    return F.filter(F.transform(F.split(csv, ","), lambda tag: F.trim(tag)), lambda tag: tag != "")


def source_rank(source: Column) -> Column:
    ranks = {name: rank for rank, (name, _, _) in enumerate(lexicon.SOURCES)}
    return F.coalesce(*(F.when(source == name, F.lit(rank)) for name, rank in ranks.items()))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view in the raw-listing schema, order columns included."""
    return listing_rows(spark, sf_dir).select(
        "source",
        "source_job_id",
        "source_job_url",
        "title",
        "company",
        "location_raw",
        F.lit(None).cast("string").alias("salary_text"),
        "description_text",
        csv_tags(F.col("tags_csv")).alias("tags"),
        "posted_at_raw",
        "employment_type_raw",
        "remote_type_raw",
        source_rank(F.col("source")).alias("src_rank"),
        F.col("order_key").alias("payload_id"),
        F.col("seq").alias("pos"),
    )


def jobs(spark: SparkSession, sf_dir: str, where: str | None = None, wanted: Wanted | None = None) -> DataFrame:
    """The view as normalized job records; where: a test on columns of the listings, wanted: what is tested afterwards."""
    return normalize_listings(raw_listings(spark, sf_dir), AS_OF, where=where, wanted=wanted)


def _documents(rows: DataFrame, element: Column) -> DataFrame:
    """(payload_id, source, elements): the listings of eight neighbouring orders per source, in order.

    An order has a handful of lines, so a document stays small however large the tables are.
    """
    placed = F.struct(F.col("seq"), element.alias("element"))
    return rows.groupBy(F.floor(F.col("order_key") / 8).alias("payload_id"), "source").agg(
        F.transform(F.sort_array(F.collect_list(placed)), lambda x: x.element).alias("elements")
    )


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as JSON payloads in the layouts of the three feeds; the last source uses the generic one."""
    col = F.col
    rows = listing_rows(spark, sf_dir).withColumn("tags", csv_tags(col("tags_csv")))
    html = F.concat(F.lit("<div><p>"), col("description_text"), F.lit("</p><script>x</script></div>"))
    element = (
        F.when(col("source") == "arbeitnow", F.to_json(F.struct(
            col("source_job_id").alias("slug"), "title", col("company").alias("company_name"),
            col("location_raw").alias("location"), (col("location_raw") == "Remote").alias("remote"),
            col("employment_type_raw").alias("job_type"), "tags", col("source_job_url").alias("url"),
            col("posted_at_raw").alias("created_at"), html.alias("description"),
        )))
        .when(col("source") == "remotive", F.to_json(F.struct(
            col("source_job_id").alias("id"), "title", col("company").alias("company_name"),
            col("location_raw").alias("candidate_required_location"), col("employment_type_raw").alias("job_type"),
            col("tags_csv").alias("tags"), col("source_job_url").alias("url"),
            col("posted_at_raw").alias("publication_date"), col("description_text").alias("description"),
        )))
        .when(col("source") == "themuse", F.to_json(F.struct(
            col("source_job_id").alias("id"), col("title").alias("name"),
            F.struct(col("company").alias("name")).alias("company"),
            F.array(F.struct(col("location_raw").alias("name"))).alias("locations"),
            F.struct(col("source_job_url").alias("landing_page")).alias("refs"),
            col("posted_at_raw").alias("publication_date"), col("description_text").alias("contents"),
            col("employment_type_raw").alias("type"),
        )))
        .otherwise(F.to_json(F.struct(
            col("source_job_id").alias("id"), col("title").alias("position"), "company",
            col("location_raw").alias("location"), col("source_job_url").alias("apply_url"), "tags",
            col("posted_at_raw").alias("date"), col("description_text").alias("description"),
            (col("order_key") % 5 * 10000).alias("salary_min"),
            (col("order_key") % 3 * 25000).cast("string").alias("salary_max"),
        )))
    )
    docs = _documents(rows, element)
    listed = F.concat(F.lit("["), F.array_join("elements", ","), F.lit("]"))
    body = (
        F.when(col("source") == "kariyer", listed)
        .when(col("source") == "themuse", F.concat(F.lit('{"results":'), listed, F.lit("}")))
        .when((col("source") == "arbeitnow") & (col("payload_id") % 2 == 0), F.concat(F.lit('{"data":'), listed, F.lit("}")))
        .otherwise(F.concat(F.lit('{"jobs":'), listed, F.lit("}")))
    )
    return docs.select(
        "payload_id", "source", body.alias("body"), F.lit("json").alias("payload_type"),
        source_rank(col("source")).alias("src_rank"),
    )


def write_landing(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Events as landed files: a thousand neighbouring ones each, for a known and an unknown source.

    Every seventh element is no record, every fifth file is cut off.
    """
    col = F.col
    events = table(spark, sf_dir, "events").withColumn("part", F.floor(col("event_id") / 1000))
    element = F.when(col("event_id") % 7 == 0, F.lit("5")).otherwise(
        F.to_json(F.struct(col("event_id").alias("id"), col("event_type").alias("title")))
    )
    source = F.when(col("event_id") % 2 == 0, "remotive").otherwise("newcomer")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", element.alias("element")))), lambda x: x.element)
    files = events.groupBy(source.alias("source"), "part").agg(ordered.alias("elements"))
    listed = F.concat(F.lit("["), F.array_join("elements", ", "), F.lit("]"))
    body = F.when(col("part") % 5 == 4, F.rtrim(listed, F.lit("]"))).otherwise(listed)
    lines = files.select("source", body.alias("value"))
    lines.write.partitionBy("source").option("maxRecordsPerFile", 1).text(root)


def card_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view as HTML card documents."""
    card = F.concat(
        F.lit('<div data-testid="job-item"><a data-testid="job-title" href="/is-ilani/'), F.col("seq").cast("string"),
        F.lit('"> '), F.col("title"), F.lit(' </a><div data-testid="company-name">'), F.col("company"),
        F.lit('</div><div data-testid="job-location">'), F.col("location_raw"), F.lit("</div></div>"),
    )
    docs = _documents(listing_rows(spark, sf_dir).withColumn("source", F.lit("kariyer")), card)
    body = F.concat(F.lit("<html><body>"), F.array_join("elements", "\n"), F.lit("</body></html>"))
    return docs.select("payload_id", "source", body.alias("body"), F.lit("html").alias("payload_type"))


def row_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view as HTML tables of the generic layout."""
    row = F.concat(
        F.lit('<tr class="job" data-id="'), F.col("seq").cast("string"), F.lit('" data-tags="'), F.col("tags_csv"),
        F.lit('" data-date="'), F.col("posted_at_raw"), F.lit('"><td class="company"><a class="preventLink" href="'),
        F.coalesce("source_job_url", F.lit("#none")), F.lit('"><h2 itemprop="title">'), F.col("title"),
        F.lit('</h2></a><h3 itemprop="name">'), F.col("company"), F.lit('</h3><div class="location">'),
        F.col("location_raw"), F.lit('</div><div class="description"><p>'), F.col("description_text"),
        F.lit('</p></div></td></tr>'),
    )
    docs = _documents(listing_rows(spark, sf_dir), row)
    body = F.concat(F.lit("<table>"), F.array_join("elements", ""), F.lit("</table>"))
    return docs.select(
        "payload_id", "source", body.alias("body"), F.lit("https://example.com/list").alias("url"),
        F.lit("page").alias("payload_type"),
    )
