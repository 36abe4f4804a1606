"""The registered queries: each operator over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.functions import markup, text, times, urls
from joblode.functions import variants as V
from joblode.operators import dedupe, insights, match, overlap, ratecap, responses, search, upsert
from joblode.plans import listing_view as view
from joblode.operators.normalize import normalize_listings
from joblode.schemas import JOB, ORDER_COLUMNS
from joblode.session import shared_folder, written
from joblode.operators.ingest import ingest
from joblode.sources.derived import GRAMS, NAMES
from joblode.sources.landing import payload_table, read_payloads
from joblode.sources.payloads import checked_records, parse_payloads, quarantine
from joblode.sources.ranges import SortedJobs
from joblode.sources.store import JobTable
from joblode.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]

FIRST_BATCH_AT = datetime(2026, 3, 22, 9, 0, tzinfo=timezone.utc)
SECOND_BATCH_AT = datetime(2026, 3, 23, 11, 30, tzinfo=timezone.utc)
CAP_LIMIT = 2
CAP_WINDOW_SECONDS = 6 * 3600

SEARCH_FILTERED = search.SearchSpec(
    q="python", employment_type="full_time", seniority="senior", remote=True, limit=50
)
SEARCH_COUNTRY = search.SearchSpec(country="TR", seniority="lead", limit=50, page=2)
SEARCH_LOCATION = search.SearchSpec(location="europe", remote=False, limit=50)
SEARCH_PAGE = search.SearchSpec(limit=50, page=3)
SEARCH_DEEP = search.SearchSpec(limit=5, page=10_000)
SEARCH_DEEP_FILTERED = search.SearchSpec(remote=True, q="engineer", limit=7, page=900)
SEARCH_STORED = search.SearchSpec(q="kubernetes", location="asia", limit=50, page=2)
SEARCH_INGESTED = search.SearchSpec(q="engineer", remote=True, limit=40, page=2)
SEARCH_META = search.SearchSpec(q="java", country="a", limit=7, page=2)


def joined(items: Column) -> Column:
    return F.array_join(items, ",")


def stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def norm_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.jobs(spark, sf_dir).select(
        "pos", "language", "normalized_title", "location_city", "location_country", "description_snippet"
    )


def norm_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.jobs(spark, sf_dir).select("pos", "remote_type", "employment_type", "seniority_level")


def norm_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.jobs(spark, sf_dir).select("pos", joined(F.col("skills")).alias("skills"))


def norm_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.jobs(spark, sf_dir).select("pos", "id", "source", "source_job_id", "source_job_url")


def norm_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs whose hosts hold letters of several scripts, and the ids behind them."""
    letters, key = F.lit(view.HOST_LETTERS), F.col("payload_id")
    size = len(view.HOST_LETTERS)
    label = F.substr(letters, (key % size + 1).cast("int"), (F.floor(key / size) % 9 + 1).cast("int"))
    place = F.concat(F.lit("HTTPS://"), label, F.lit(".Example.com/p/"), F.col("pos"))
    rows = view.raw_listings(spark, sf_dir).withColumns({"source_job_url": place, "source_job_id": F.col("pos")})
    return normalize_listings(rows, view.AS_OF).select("pos", "id", "source_job_url")


def norm_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.jobs(spark, sf_dir).select("pos", stamp(F.col("posted_at")).alias("posted_at"), "freshness_days")


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning, snippet and language hint on long texts."""
    docs = view.table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))
    return docs.select(
        "doc_id",
        F.md5("cleaned").alias("cleaned_md5"),
        text.snippet(F.col("cleaned")).alias("snippet"),
        text.language(F.col("cleaned")).alias("language"),
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical and validated form of real URLs."""
    return view.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.canonical_url(F.col("url")).alias("canonical"),
        urls.valid_http_url(F.col("url")).alias("valid"),
    )


def dedupe_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = view.raw_listings(spark, sf_dir).withColumn("payload_id", F.col("payload_id") % 50)
    return dedupe.dedupe_within_payload(listings).select("pos", "source", "payload_id")


def dedupe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_across_sources(view.raw_listings(spark, sf_dir)).select("pos", "source", "source_job_url")


def dedupe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_job_url"))
    return dedupe.dedupe_across_sources(pages, ["page_id"])


_HIT = ["id", "title", "company", "location_raw", "remote_type", "employment_type", "seniority_level", "freshness_days"]


def _search(spec: search.SearchSpec) -> Query:
    return lambda spark, sf_dir: search.search_listings(view.raw_listings(spark, sf_dir), view.AS_OF, spec).select(*_HIT)


def search_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_meta(view.jobs(spark, sf_dir, wanted=search.wanted(SEARCH_META)), SEARCH_META)


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_of_listings(view.raw_listings(spark, sf_dir), view.AS_OF).select(*_HIT)


def top_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.top_skills(view.jobs(spark, sf_dir), 20, ORDER_COLUMNS)


def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.top_companies(view.jobs(spark, sf_dir), 10, ORDER_COLUMNS)


def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.top_locations(view.jobs(spark, sf_dir), 10, ORDER_COLUMNS)


def insight_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.insight_report(insights.top_skills(view.jobs(spark, sf_dir), 50, ORDER_COLUMNS), "skills")


def lookup_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records behind one id per company."""
    jobs = view.jobs(spark, sf_dir)
    ids = jobs.groupBy("company").agg(F.min("id").alias("id")).select("id")
    return search.jobs_by_id(jobs, ids).select(*_HIT)


def _first_half(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> JobTable:
    table = JobTable(spark, f"{shared_folder(spark)}/jobs-{uuid4().hex}", keep=keep)
    table.unstaged(table.upsert(view.jobs(spark, sf_dir, "payload_id % 2 = 0"), FIRST_BATCH_AT, "even"))
    return table


def _merged_table(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> JobTable:
    table = _first_half(spark, sf_dir, keep)
    table.unstaged(table.upsert(view.jobs(spark, sf_dir, "payload_id % 2 = 1"), SECOND_BATCH_AT, "odd"))
    return table


def _repointed_batch(spark: SparkSession, sf_dir: str, first: bool) -> DataFrame:
    """Lines of orders as job records: three ids and three URLs an order, tied anew by each line."""
    part, supplier, line = (F.split("seq", "-")[i].cast("long") for i in (1, 2, 3))
    rows = view.listing_rows(spark, sf_dir).where((line <= 3) == F.lit(first))
    place = F.when(part % 4 > 0, F.concat(F.lit("https://jobs.example.com/o/"), F.col("order_key").cast("string"), F.lit("/"), (part % 4).cast("string")))
    made = rows.select(
        F.concat(F.lit("j"), F.col("order_key").cast("string"), F.lit("-"), (supplier % 3).cast("string")).alias("id"),
        place.alias("source_job_url"), "source", "title", "company",
        view.source_rank(F.col("source")).alias("src_rank"), F.col("order_key").alias("payload_id"), F.col("seq").alias("pos"),
    )
    rest = {f.name: F.lit(None).cast(f.dataType) for f in JOB.fields if f.name not in made.columns}
    return made.withColumns(rest)


def upsert_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches whose ids change their URL from record to record, merged in order of arrival."""
    table = JobTable(spark, f"{shared_folder(spark)}/jobs-{uuid4().hex}")
    table.unstaged(table.upsert(_repointed_batch(spark, sf_dir, True), FIRST_BATCH_AT))
    table.unstaged(table.upsert(_repointed_batch(spark, sf_dir, False), SECOND_BATCH_AT))
    return table.read().select("id", "source_job_url", "title", *(stamp(F.col(name)).alias(name) for name in ("created_at", "updated_at")))


def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows by the URLs and ids of listings, through the index and the buckets."""
    table = _merged_table(spark, sf_dir)
    wanted = view.jobs(spark, sf_dir, "payload_id % 64 = 3").select("id", "source_job_url")
    wanted = table.staged(wanted)
    found = {"id": table.by_ids(wanted), "url": table.by_urls(wanted)}
    return reduce(DataFrame.unionByName, (rows.select("id", "source_job_url", F.lit(way).alias("way")) for way, rows in found.items()))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the stored table through its postings."""
    return _merged_table(spark, sf_dir, (GRAMS,)).search(SEARCH_STORED).select(*_HIT)


def kept_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights out of the counts that merges keep."""
    table = _merged_table(spark, sf_dir, (NAMES,))
    found = {name: table.top(name, 15) for name in insights.DIMENSIONS}
    return reduce(DataFrame.unionByName, (rows.withColumn("dimension", F.lit(name)) for name, rows in found.items()))


def _deep_page(spec: search.SearchSpec) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranges = SortedJobs(spark, _folder(spark, "ranges")).build(view.jobs(spark, sf_dir))
        return ranges.page(spec).select(*_HIT)

    return query


def match_all_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all jobs for each candidate."""
    columns = ["id", "skills", "remote_type", "location_raw", "freshness_days", "title", *ORDER_COLUMNS]
    jobs = written("all-jobs", view.jobs(spark, sf_dir).select(*columns))
    return overlap.match_all(candidates(spark, sf_dir), jobs, order_columns=ORDER_COLUMNS)


def list_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored job."""
    return search.list_jobs(_merged_table(spark, sf_dir).jobs()).select("id", "title", "company", "freshness_days")


def stored_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights over the stored table."""
    jobs = _merged_table(spark, sf_dir).jobs()
    found = {"skills": insights.top_skills(jobs, 15), "companies": insights.top_companies(jobs, 15), "locations": insights.top_locations(jobs, 15)}
    return reduce(DataFrame.unionByName, (rows.withColumn("dimension", F.lit(name)) for name, rows in found.items()))


def insert_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second half that the table does not know."""
    table = _first_half(spark, sf_dir)
    batch = view.jobs(spark, sf_dir, "payload_id % 2 = 1").select("pos", "id", "source_job_url")
    return upsert.new_records(table.read(), table.staged(batch)).select("pos", "id")


def ingest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: payloads, dedupe in and across sources, normalization, a page of a search."""
    jobs = ingest(payload_table(view.json_payloads(spark, sf_dir)), view.AS_OF)
    return search.search_page(jobs, SEARCH_INGESTED).select(*_HIT)


def landing_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files of a known and an unknown source: what is read and what is left out."""
    root = f"{shared_folder(spark)}/landing-{uuid4().hex}"
    view.write_landing(spark, sf_dir, root)
    return checked_records(read_payloads(spark, root)).select("src_rank", "pos", "source_job_id", "title", "reject_reason")


def landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files taken in by the stream, into the stored table."""
    root = f"{shared_folder(spark)}/landing-{uuid4().hex}"
    view.write_landing(spark, sf_dir, root)
    table = JobTable(spark, f"{root}-table")
    query = start_ingest(spark, root, table, f"{root}-checkpoint", clock=lambda: FIRST_BATCH_AT, name=f"landing-{uuid4().hex}", available_now=True)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return table.read().select("source", "source_job_id", "title", stamp(F.col("created_at")).alias("created_at"))


def single_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one source out of the landed files."""
    root = f"{shared_folder(spark)}/landing-{uuid4().hex}"
    view.write_landing(spark, sf_dir, root)
    return parse_payloads(read_payloads(spark, root, only_source="remotive")).select("source", "source_job_id", "title")


def bounds_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the reason why they are out of bounds."""
    some = candidates(spark, sf_dir).withColumns({
        "skills": F.when(F.col("candidate_id") % 5 > 0, F.col("skills")).otherwise(F.array().cast("array<string>")),
        "experience_years": F.when(F.col("candidate_id") % 7 > 0, F.col("experience_years") - 1),
    })
    return match.check_candidates(some).select("candidate_id", "reject_reason")


def top_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations where the raw text is missing for half of the jobs: city and country stand in."""
    jobs = view.jobs(spark, sf_dir)
    raw = F.when(F.col("payload_id") % 2 == 0, F.col("location_raw"))
    return insights.top_locations(jobs.withColumn("location_raw", raw), 30, ORDER_COLUMNS)


def feed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed records with several locations, one of them without a name."""
    rows = view.listing_rows(spark, sf_dir)
    places = F.array(*(F.struct(name.alias("name")) for name in (F.col("location_raw"), F.lit(None).cast("string"), F.col("company"))))
    record = F.try_parse_json(F.to_json(F.struct(places.alias("locations"))))
    return rows.select(F.col("seq").alias("pos"), V.location_names_at(record, "$.locations").alias("places"))


def upsert_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole view merged in two batches."""
    return _merged_table(spark, sf_dir).read().select(
        "id", "source", "source_job_id", "source_job_url", "title", joined(F.col("skills")).alias("skills"),
        *(stamp(F.col(name)).alias(name) for name in ("created_at", "updated_at", "last_seen_at")),
    )


def schema_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table without language, updated_at and last_seen_at, brought up to date."""
    seen = F.when(F.col("src_rank") == 0, F.lit(None)).otherwise(times.audit_moment(FIRST_BATCH_AT))
    legacy = view.jobs(spark, sf_dir).drop("language").withColumn("created_at", seen.cast("timestamp"))
    return upsert.upgrade(legacy, SECOND_BATCH_AT).select(
        "pos", "language", *(stamp(F.col(name)).alias(name) for name in ("created_at", "updated_at", "last_seen_at"))
    )


def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and dates through the flat text form and back."""
    flat = upsert.to_export(view.jobs(spark, sf_dir))
    return upsert.from_export(flat).select(
        "id", joined(F.col("skills")).alias("skills"), stamp(F.col("posted_at")).alias("posted_at")
    )


_LISTING = [
    "source", "source_job_id", "source_job_url", "title", "company", "location_raw", "salary_text",
    "description_text", "posted_at_raw", "employment_type_raw", "remote_type_raw",
]


def json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = payload_table(view.json_payloads(spark, sf_dir))
    return parse_payloads(payloads).select(*_LISTING, joined(F.col("tags")).alias("tags"))


def html_cards_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = payload_table(view.card_payloads(spark, sf_dir))
    return parse_payloads(payloads).select("source", "source_job_id", "source_job_url", "title", "company", "location_raw")


def html_rows_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = payload_table(view.row_payloads(spark, sf_dir))
    return parse_payloads(payloads).select(*_LISTING, joined(F.col("tags")).alias("tags"))


def payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made from events; some are cut off, some have text behind the value or a bracket too many,
    some hold elements that are not records."""
    tail = F.element_at(F.array(*(F.lit(t) for t in ("", "]", "}", ", 5", "] and more", ', "a": 1}'))), (F.col("event_id") % 6 + 1).cast("int"))
    body = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"jobs": ['), F.col("props")))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"jobs": [5, "x", '), F.col("props"), F.lit("]}")))
        .otherwise(F.concat(F.lit('{"jobs": [{"id": '), F.col("event_id").cast("string"), F.lit("}]}"), tail))
    )
    rows = view.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("payload_id"), F.lit("remotive").alias("source"), body.alias("body")
    )
    return quarantine(payload_table(rows)).select("payload_id", "pos", "reject_reason")


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.try_parse_json("props")
    return view.table(spark, sf_dir, "events").select(
        "event_id", V.text_at(props, "$.k").alias("k"), V.whole_number_at(props, "$.k").alias("k_number")
    )


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view.table(spark, sf_dir, "pages")
    return pages.select("page_id", markup.html_text(F.col("html")).alias("text"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view.table(spark, sf_dir, "pages")
    return pages.select("page_id", markup.page_link(F.col("html"), F.col("url")).alias("link"))


def _ranked_lists(jobs: DataFrame) -> DataFrame:
    """One list per order: the ids of its listings with the first one repeated and an unknown one."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x.id)
    return jobs.groupBy(F.col("payload_id").alias("list_id")).agg(ids.alias("ids")).select(
        "list_id", F.concat(F.slice("ids", 1, 1), F.array(F.lit("missing")), F.col("ids")).alias("job_ids")
    )


def ranked_list_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = written("listed-jobs", view.jobs(spark, sf_dir).select("id", "title", *ORDER_COLUMNS))
    resolved = match.resolve_ranked_lists(_ranked_lists(jobs), jobs, order_columns=ORDER_COLUMNS)
    return resolved.select("list_id", "rank", "match_score", "job.id", "job.title")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    skills = (
        F.when(key % 4 == 0, F.array(F.lit("Python"), F.lit("sql")))
        .when(key % 4 == 1, F.array(F.lit("kubernetes"), F.lit("postgresql"), F.lit("python")))
        .when(key % 4 == 2, F.array(F.lit("node"), F.lit("typescript"), F.lit("java")))
        .otherwise(F.array(F.lit("cobol")))
    )
    return view.table(spark, sf_dir, "customer").select(
        key.alias("candidate_id"),
        skills.alias("skills"),
        (key % 12).cast("int").alias("experience_years"),
        F.when(key % 3 == 0, "Asia").when(key % 3 == 1, "istanbul").alias("preferred_location"),
        F.when(key % 5 < 3, key % 5 == 0).alias("remote_preferred"),
    )


def candidate_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_candidates(
        candidates(spark, sf_dir), view.jobs(spark, sf_dir), order_columns=ORDER_COLUMNS
    )


def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the job record out of the pool."""
    found = match.match_records(candidates(spark, sf_dir), view.jobs(spark, sf_dir), order_columns=ORDER_COLUMNS)
    return found.select("candidate_id", "rank", "match_score", "job.id", "job.title", "job.company")


def response_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored records behind response texts that list the ids of an order, fenced, with blanks and repeats."""
    jobs = written("listed-jobs", view.jobs(spark, sf_dir).select("id", "title", *ORDER_COLUMNS))
    quoted = F.transform("job_ids", lambda x: F.concat(F.lit('" '), x, F.lit('"')))
    text = F.concat(F.lit("```json\n["), F.array_join(quoted, ", "), F.lit("]\n```"))
    text = F.when(F.col("list_id") % 5 == 0, F.concat(text, F.lit("]"))).otherwise(text)
    said = _ranked_lists(jobs).select(F.col("list_id").alias("response_id"), F.lit("match").alias("kind"), text.alias("text"))
    found = responses.matches_from_responses(said, jobs, ORDER_COLUMNS)
    return found.select("response_id", "rank", "match_score", "job.id", "job.title")


def gap_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("candidate_id")
    title = (
        F.when(key % 3 == 0, "Senior Python API engineer")
        .when(key % 3 == 1, "data engineer (remote)")
        .otherwise("Astronaut")
    )
    return candidates(spark, sf_dir).select(
        key.alias("request_id"), F.col("skills").alias("current_skills"), title.alias("target_job_title")
    )


def skills_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.skills_gap(gap_requests(spark, sf_dir), view.jobs(spark, sf_dir))


def missing_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = match.missing_skills(gap_requests(spark, sf_dir), view.jobs(spark, sf_dir))
    return lists.select("request_id", joined(F.col("missing_skills")).alias("missing_skills"))


def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.match_prompts(candidates(spark, sf_dir), view.jobs(spark, sf_dir), order_columns=ORDER_COLUMNS)


def gap_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.gap_prompts(gap_requests(spark, sf_dir))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response texts made from orders: plain, fenced and broken JSON of both kinds."""
    key = F.col("o_orderkey")
    ids = F.concat(F.lit('["job-'), key.cast("string"), F.lit('", " ", 7, " job-x "]'))
    gap = F.concat(
        F.lit('{"missing_skills": ["sql", "'), F.col("o_orderpriority"),
        F.lit('"], "learning_priority": "high", "estimated_learning_time": "3 months"}'),
    )
    fence = F.lit("```")
    body = (
        F.when(key % 8 == 0, ids)
        .when(key % 8 == 1, F.concat(fence, F.lit("json\n"), ids, F.lit("\n"), fence))
        .when(key % 8 == 2, F.concat(F.lit("Sure: "), ids))
        .when(key % 8 == 3, gap)
        .when(key % 8 == 4, F.concat(F.lit("  "), fence, F.lit("\n"), gap, fence))
        .when(key % 8 == 5, F.lit("   "))
        .when(key % 32 == 14, F.concat(ids, F.lit("] and more")))
        .when(key % 32 == 22, F.concat(ids, F.lit("}")))
        .when(key % 32 == 30, F.concat(ids, F.lit(", 1")))
        .when(key % 8 == 6, F.concat(ids, F.lit(" trailing")))
        .otherwise(F.lit('{"missing_skills": ["sql", 5], "learning_priority": "low", "estimated_learning_time": "x"}'))
    )
    kind = F.when(F.floor(key / 8) % 5 == 0, "gap").when(key % 8 < 3, "match").otherwise("gap")
    return view.table(spark, sf_dir, "orders").select(key.alias("response_id"), kind.alias("kind"), body.alias("text"))


def response_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = responses.clean_responses(model_responses(spark, sf_dir))
    return cleaned.select(
        "response_id", "kind", joined(F.col("job_ids")).alias("job_ids"),
        joined(F.col("analysis.missing_skills")).alias("missing_skills"),
        F.col("analysis.learning_priority").alias("learning_priority"), "error_code",
    )


def event_rate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some events lack a key, some a time."""
    events = view.table(spark, sf_dir, "events").withColumns({
        "user_id": F.when(F.col("event_id") % 97 != 0, F.col("user_id")),
        "ts": F.when(F.col("event_id") % 101 != 0, F.col("ts")),
    })
    capped = ratecap.rate_cap(events, "user_id", "ts", "event_id", CAP_LIMIT, CAP_WINDOW_SECONDS)
    return capped.select("user_id", "event_id", F.col("accepted").cast("int").alias("accepted"))


QUERIES: dict[str, Query] = {
    "norm_text_fields": norm_text_fields,
    "norm_classify": norm_classify,
    "norm_skills": norm_skills,
    "norm_ids": norm_ids,
    "norm_hosts": norm_hosts,
    "norm_time": norm_time,
    "document_text": document_text,
    "page_urls": page_urls,
    "dedupe_payload": dedupe_payload,
    "dedupe_url": dedupe_url,
    "dedupe_pages": dedupe_pages,
    "search_filtered": _search(SEARCH_FILTERED),
    "search_country_tr": _search(SEARCH_COUNTRY),
    "search_location": _search(SEARCH_LOCATION),
    "search_page3": _search(SEARCH_PAGE),
    "search_page10000": _deep_page(SEARCH_DEEP),
    "search_deep_filtered": _deep_page(SEARCH_DEEP_FILTERED),
    "search_meta": search_meta,
    "recent_jobs": recent_jobs,
    "top_skills": top_skills,
    "top_companies": top_companies,
    "top_locations": top_locations,
    "insight_count": insight_count,
    "lookup_by_ids": lookup_by_ids,
    "upsert_two_batches": upsert_two_batches,
    "upsert_repointed": upsert_repointed,
    "stored_lookup": stored_lookup,
    "stored_search": stored_search,
    "kept_insights": kept_insights,
    "list_jobs": list_jobs,
    "stored_insights": stored_insights,
    "insert_branch": insert_branch,
    "schema_backfill": schema_backfill,
    "export_roundtrip": export_roundtrip,
    "json_ingest": json_ingest,
    "ingest_search": ingest_search,
    "landing_quarantine": landing_quarantine,
    "landing_stream": landing_stream,
    "single_source": single_source,
    "bounds_report": bounds_report,
    "top_places": top_places,
    "feed_places": feed_places,
    "html_cards_ingest": html_cards_ingest,
    "html_rows_ingest": html_rows_ingest,
    "payload_quarantine": payload_quarantine,
    "event_props_json": event_props_json,
    "html_text": html_text,
    "html_links": html_links,
    "ranked_list_resolve": ranked_list_resolve,
    "response_matches": response_matches,
    "candidate_match": candidate_match,
    "match_all_jobs": match_all_jobs,
    "match_records": match_records,
    "skills_gap": skills_gap,
    "missing_skills": missing_skills,
    "prompt_table": prompt_table,
    "gap_prompts": gap_prompts,
    "response_clean": response_clean,
    "event_rate_cap": event_rate_cap,
}
