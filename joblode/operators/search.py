"""Filtered, sorted and paginated search over job records."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions.text import WHITESPACE, any_of, join_present
from joblode.operators.normalize import Wanted, normalize_listings
from joblode.schemas import JOB_FIELDS, ORDER_COLUMNS, STORED_ORDER_COLUMNS


@dataclass(frozen=True)
class SearchSpec:
    q: str | None = None
    country: str | None = None
    location: str | None = None
    remote: bool | None = None
    employment_type: str | None = None
    seniority: str | None = None
    page: int = 1
    limit: int | None = None
    default_size: int = lexicon.PAGE_SIZE_DEFAULT
    max_size: int = lexicon.PAGE_SIZE_MAX

    def __post_init__(self) -> None:
        check_between("page", self.page, 1)
        if self.limit is not None:
            check_between("limit", self.limit, 1, lexicon.PAGE_SIZE_MAX)
        check_between("default_size", self.default_size, 1, self.max_size)
        check_member("employment_type", self.employment_type, [*lexicon.EMPLOYMENT_TYPES, "other"])
        check_member("seniority", self.seniority, [*lexicon.SENIORITY_LEVELS, "unknown"])

    @property
    def size(self) -> int:
        return min(self.limit or self.default_size, self.max_size)


def check_between(name: str, value: int, low: int, high: int | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))


def check_member(name: str, value: str | None, allowed: list[str]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def _free_text() -> Column:
    fields = [F.col(name) for name in ("title", "normalized_title", "company", "description_snippet")]
    return F.lower(join_present(" ", *fields, F.array_join("skills", " ")))


def query_matches(q: str) -> Column:
    """Literal, case-insensitive substring of the joined text fields; a hit may span two fields."""
    return _free_text().contains(q.lower())


def _place_text() -> Column:
    return F.lower(join_present(" ", *(F.col(f"location_{part}") for part in ("raw", "city", "country"))))


def location_matches(location: str) -> Column:
    return _place_text().contains(location.lower())


def country_matches(country: str, turkey_markers: list[str] = lexicon.TURKEY_MARKERS) -> Column:
    """"tr" stands for any marker of Turkey; other values are plain substrings."""
    wanted = country.strip().lower()
    if wanted != "tr":
        return _place_text().contains(wanted)
    padded = F.concat(F.lit(" "), _place_text(), F.lit(" "))
    return any_of([padded.contains(marker) for marker in turkey_markers])


def searched_texts() -> dict[str, Column]:
    """The texts in which needles are looked up, each under a mark."""
    return {"t": _free_text(), "p": _place_text()}


def needles(spec: SearchSpec) -> list[tuple[str, str]]:
    """(mark, needle): substrings that every hit holds. The markers of Turkey are alternatives and give none."""
    found = [("t", spec.q or ""), ("p", spec.location or "")]
    if spec.country and spec.country.strip().lower() != "tr":
        found.append(("p", spec.country.strip()))
    return [(mark, needle.lower()) for mark, needle in found if needle]


def has_tests(spec: SearchSpec) -> bool:
    """Whether a search filters at all."""
    return any(value not in (None, "") for value in (spec.q, spec.country, spec.location, spec.remote, spec.employment_type, spec.seniority))


_REMOTE = ["remote", "hybrid"]


def remote_matches(remote: bool) -> Column:
    """Remote and hybrid count as remote; unknown matches neither way."""
    return F.col("remote_type").isin(*_REMOTE) if remote else F.col("remote_type") == "onsite"


def wanted(spec: SearchSpec) -> Wanted:
    """The tests of a search in the form in which normalize_listings() makes use of them."""
    places = [test(value) for test, value in ((country_matches, spec.country), (location_matches, spec.location)) if value]
    labels = {
        "remote_type": None if spec.remote is None else _REMOTE if spec.remote else ["onsite"],
        "employment_type": spec.employment_type and [spec.employment_type],
        "seniority_level": spec.seniority and [spec.seniority],
    }
    q = (spec.q or "").lower()
    return Wanted(
        place=reduce(and_, places) if places else None,
        labels={name: named for name, named in labels.items() if named},
        text=None if not q or any(char in WHITESPACE for char in q) else q,
    )


def filter_jobs(jobs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Equality tests first: those reach the Parquet scan, the substring tests do not."""
    tests = []
    if spec.employment_type is not None:
        tests.append(F.col("employment_type") == spec.employment_type)
    if spec.seniority is not None:
        tests.append(F.col("seniority_level") == spec.seniority)
    if spec.remote is not None:
        tests.append(remote_matches(spec.remote))
    if spec.country:
        tests.append(country_matches(spec.country))
    if spec.location:
        tests.append(location_matches(spec.location))
    if spec.q:
        tests.append(query_matches(spec.q))
    for test in tests:
        jobs = jobs.filter(test)
    return jobs


def search_order(order_columns: list[str] = ORDER_COLUMNS) -> list[Column]:
    """Freshest first, unknown last, then lower-cased title, then arrival."""
    return [
        F.col("freshness_days").asc_nulls_last(),
        F.lower(F.coalesce(F.col("title"), F.lit(""))).asc(),
        *(F.col(name).asc() for name in order_columns),
    ]


def stored_order(order_columns: list[str] = STORED_ORDER_COLUMNS) -> list[Column]:
    """Freshest first, unknown last, then title with missing titles first, then insert order."""
    return [
        F.col("freshness_days").asc_nulls_last(),
        F.col("title").asc_nulls_first(),
        *(F.col(name).asc() for name in order_columns),
    ]


def search_page(jobs: DataFrame, spec: SearchSpec, order_columns: list[str] = ORDER_COLUMNS) -> DataFrame:
    """One page in search order. Sort, offset and limit become a single top-k operator."""
    rows = filter_jobs(jobs, spec).orderBy(*search_order(order_columns))
    return rows.offset((spec.page - 1) * spec.size).limit(spec.size).select(*JOB_FIELDS)


def search_meta(jobs: DataFrame, spec: SearchSpec) -> DataFrame:
    """(page, limit, total_pages, total_results) as one row."""
    total = filter_jobs(jobs, spec).agg(F.count("*").alias("total_results"))
    pages = F.greatest(F.ceil(F.col("total_results") / spec.size), F.lit(1))
    return total.select(
        F.lit(spec.page).alias("page"),
        F.lit(spec.size).alias("limit"),
        pages.cast("bigint").alias("total_pages"),
        "total_results",
    )


def list_jobs(jobs: DataFrame, order_columns: list[str] = STORED_ORDER_COLUMNS) -> DataFrame:
    """Every job in stored order."""
    return jobs.orderBy(*stored_order(order_columns)).select(*JOB_FIELDS)


def recent_jobs(
    jobs: DataFrame, limit: int = lexicon.MATCH_POOL, order_columns: list[str] = STORED_ORDER_COLUMNS
) -> DataFrame:
    """The first `limit` jobs in stored order."""
    return jobs.orderBy(*stored_order(order_columns)).limit(limit).select(*JOB_FIELDS)


def _of_listings(
    listings: DataFrame, as_of: date | datetime, pick: Callable[[DataFrame], DataFrame], order: list[Column],
    order_columns: list[str], options: dict, tests: Wanted | None = None,
) -> DataFrame:
    """The jobs that `pick` takes, a bounded number: first with the columns that it reads alone, then whole."""
    picked = pick(normalize_listings(listings, as_of, wanted=tests, **options)).select(*(F.col(name).alias(f"_{name}") for name in order_columns))
    same = reduce(and_, (F.col(name).eqNullSafe(F.col(f"_{name}")) for name in order_columns))
    few = listings.join(F.broadcast(picked), same, "left_semi")
    return normalize_listings(few, as_of, **options).orderBy(*order).select(*JOB_FIELDS)


def search_listings(
    listings: DataFrame, as_of: date | datetime, spec: SearchSpec, order_columns: list[str] = ORDER_COLUMNS, **options
) -> DataFrame:
    """search_page() over raw listings: tests and order are read from the columns they need, and only the listings of
    the page, at most spec.size, are finished. The order columns must tell listings apart. options: of normalize_listings()."""
    order = search_order(order_columns)

    def pick(jobs: DataFrame) -> DataFrame:
        return filter_jobs(jobs, spec).orderBy(*order).offset((spec.page - 1) * spec.size).limit(spec.size)

    return _of_listings(listings, as_of, pick, order, order_columns, options, wanted(spec))


def recent_of_listings(
    listings: DataFrame, as_of: date | datetime, limit: int = lexicon.MATCH_POOL, order_columns: list[str] = ORDER_COLUMNS, **options
) -> DataFrame:
    """recent_jobs() over raw listings, finished like the page of search_listings(). Its limit is checked: it bounds a broadcast."""
    check_between("limit", limit, 1, lexicon.MATCH_POOL_MAX)
    order = stored_order(order_columns)
    return _of_listings(listings, as_of, lambda jobs: jobs.orderBy(*order).limit(limit), order, order_columns, options)


class JobNotFound(LookupError):
    pass


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    """The job with this id, as a frame of at most one row; the id test reaches the Parquet scan."""
    return jobs.filter(F.col("id") == job_id).select(*JOB_FIELDS)


def require_job(jobs: DataFrame, job_id: str):
    """The single row behind an id, or JobNotFound."""
    row = get_job(jobs, job_id).first()
    if row is None:
        raise JobNotFound(job_id)
    return row


def jobs_by_id(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs whose id occurs in `ids(id)`."""
    return jobs.join(ids, "id", "left_semi")
