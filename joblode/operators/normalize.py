"""Raw listing -> job record, one narrow stage after the other and no shuffle."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions import identity, terms, text, times, urls
from joblode.schemas import JOB_FIELDS, ORDER_COLUMNS, RAW_FIELDS


def with_reject_reason(listings: DataFrame) -> DataFrame:
    """Mark the listings that cannot become a job record."""
    return listings.withColumn(
        "reject_reason", F.when(times.epoch_out_of_range(F.col("posted_at_raw")), "posted_at_out_of_range")
    )


def rejected_listings(listings: DataFrame) -> DataFrame:
    return with_reject_reason(listings).filter(F.col("reject_reason").isNotNull())


def evaluate_once(records: DataFrame) -> DataFrame:
    """Keep later filters above the computed columns.

    The optimizer moves a filter below a projection by copying the expressions it mentions, and with
    columns this costly every copy is evaluated again. A projection with a nondeterministic column is
    not crossed, so filters see the finished columns. Unused columns are still pruned, nothing is
    shuffled, and the extra column exists only inside the plan.
    """
    marked = records.withColumn("_row", F.monotonically_increasing_id())
    return marked.filter(F.col("_row") >= 0).drop("_row")


@dataclass(frozen=True)
class Wanted:
    """What a caller tests afterwards, so that listings which cannot pass need not be finished.

    place: a test on location_raw, location_city and location_country. labels: for label columns the labels that pass.
    text: a lower-case piece without blanks that the title, the normalized title, the company, the snippet or a skill holds.
    """

    place: Column | None = None
    labels: dict[str, list[str]] = field(default_factory=dict)
    text: str | None = None


def _possible(listings: DataFrame, wanted: Wanted, tables: dict, stages: tuple[dict[str, Column], ...]) -> DataFrame:
    """The listings that can pass, by tests that each passing one meets; cheap ones first, no text is cut into words."""
    col, names = F.col, listings.columns
    cleaned, prepared, folded, _, _, records = stages
    if wanted.place is not None:
        found = listings.withColumn("_location", cleaned["_location"]).withColumns(
            {name: records[name] for name in ("location_city", "location_country")}
        )
        listings = evaluate_once(found).filter(wanted.place).select(*names)
    asked = {name: tables[f"{name}s"] for name in ("remote_type", "employment_type", "seniority_level")}
    entries = [
        [entry for label in labels if label in asked[name] for entry in asked[name][label]] for name, labels in wanted.labels.items()
    ]
    read = {name: value for name, value in cleaned.items() if name not in ("_url", "posted_at")}
    if any(entries):
        read_on = listings.withColumns(read).withColumn("description_snippet", prepared["description_snippet"]).withColumns(folded)
        read_on = evaluate_once(read_on.withColumn("_evidence", text.join_present(" ", col("_role"), col("_side"))))
        for spellings in filter(None, entries):
            read_on = read_on.filter(text.any_of([terms.entry_possible(col("_evidence"), entry) for entry in spellings]))
        listings = read_on.select(*names)
    if wanted.text:
        known = terms.skill_lexicon(tables["skills"], tables["aliases"])
        spellings = sorted({entry for name, held in known.items() if wanted.text in name.lower() for entry in (name, *held)})
        # a normalized ASCII title has no word that the title has not: metadata leaves blanks, case is lowered here
        other = F.octet_length("_title") > F.length("_title")
        read_on = listings.withColumns({name: read[name] for name in ("_title", "_description")}).withColumns(
            {"description_snippet": prepared["description_snippet"], "_core": F.when(other, prepared["_core"])}
        )
        normal = F.when(other, records["normalized_title"])
        role = terms.fold(text.join_present(" ", col("_title"), col("description_snippet")))
        shown = [col("title"), normal, col("company"), col("description_snippet"), F.array_join("tags", " ")]
        tagged = F.lower(F.array_join("tags", " "))
        read_on = evaluate_once(read_on.withColumns({"_shown": F.lower(text.join_present(" ", *shown)), "_role": role, "_tagged": tagged}))
        tests = [col("_shown").contains(wanted.text)]
        for entry in spellings:
            tests += [terms.entry_possible(col("_role"), entry), col("_tagged").contains(entry.lower())]
        listings = read_on.filter(text.any_of([F.coalesce(test, F.lit(False)) for test in tests])).select(*names)
    return listings


@lru_cache(maxsize=32)
def _expressions(application: str, lexicons: str) -> tuple[dict[str, Column], ...]:
    """The column expressions, stage by stage.

    Building them takes thousands of calls into the JVM. They name their inputs only by column, so one
    set serves every frame of an application that asks for the same lexicons, whatever its clock.
    """
    col = F.col
    tables = json.loads(lexicons)
    remote_types, employment_types, seniority_levels = (
        tables[name] for name in ("remote_types", "employment_types", "seniority_levels")
    )
    skills, aliases = tables["skills"], tables["aliases"]
    vocabulary = terms.single_words(
        terms.skill_lexicon(skills, aliases), remote_types, employment_types, seniority_levels
    )
    described = ("_url", "source_job_url", "company", "title", "location_raw", "posted_at_raw")
    city, country = text.city_and_country(col("_location"))

    def label(table: dict) -> Column:
        return terms.first_label(col("_evidence"), col("_hits"), table)

    cleaned = {
        "_title": text.clean(col("title")),
        "_location": text.clean(col("location_raw")),
        "_description": text.clean(col("description_text")),
        "_employment": text.clean(col("employment_type_raw")),
        "_remote": text.clean(col("remote_type_raw")),
        "_url": urls.valid_http_url(col("source_job_url")),
        "posted_at": times.posted_at(col("posted_at_raw")),
    }
    prepared = {
        "description_snippet": text.snippet(col("_description"), tables["snippet_length"]),
        "_core": text.title_core(col("_title")),
        "source": text.first_present(col("source"), F.lit(tables["default_source"])),
        "source_job_id": text.first_present(
            col("source_job_id"), identity.fallback_source_job_id(*(col(name) for name in described))
        ),
    }
    role = text.join_present(" ", col("_title"), col("description_snippet"))
    side = text.join_present(" ", col("_location"), col("_employment"), col("_remote"), F.array_join(col("tags"), " "))
    folded = {"_role": terms.fold(role), "_side": terms.fold(side)}
    hits = {
        "_role_hits": terms.vocabulary_hits(col("_role"), vocabulary),
        "_side_hits": terms.vocabulary_hits(col("_side"), vocabulary),
        "_evidence": text.join_present(" ", col("_role"), col("_side")),
    }
    merged_hits = {"_hits": F.concat("_role_hits", "_side_hits")}
    records = {
        "id": identity.job_id(col("source"), col("source_job_id"), col("_url")),
        "source_job_url": col("_url"),
        "language": text.language(col("_title")),
        "normalized_title": F.when(
            col("_title").isNotNull(),
            F.coalesce(text.blank_to_null(text.title_case(col("_core"))), col("_title")),
        ),
        "location_city": city,
        "location_country": country,
        "remote_type": label(remote_types),
        "employment_type": label(employment_types),
        "seniority_level": label(seniority_levels),
        "skills": terms.merged_skills(
            col("tags"), col("_role"), col("_role_hits"),
            skills=skills, aliases=aliases, ignored=tables["ignored_tags"],
        ),
    }
    return cleaned, prepared, folded, hits, merged_hits, records


def normalize_listings(
    listings: DataFrame,
    as_of: date | datetime,
    default_source: str = lexicon.DEFAULT_SOURCE,
    remote_types: dict = lexicon.REMOTE_TYPES,
    employment_types: dict = lexicon.EMPLOYMENT_TYPES,
    seniority_levels: dict = lexicon.SENIORITY_LEVELS,
    skills: dict = lexicon.SKILLS,
    aliases: dict = lexicon.SKILL_ALIASES,
    ignored_tags: list = lexicon.IGNORED_TAGS,
    snippet_length: int = lexicon.SNIPPET_LENGTH,
    where: Column | str | None = None,
    wanted: Wanted | None = None,
) -> DataFrame:
    """Every job field, plus whatever other columns the listings carry (order columns, for one).

    where: a test on columns of the listings. It runs before anything is computed and reaches the scan,
    which a filter on the result does not: see evaluate_once(). snippet_length: characters of the
    description that are kept; labels and skills are read from the title and this snippet. wanted: listings
    that cannot pass the tests named there are left out early; the caller still makes the tests.

    The expensive intermediate texts are columns of their own stage, so each is computed once per row;
    stages whose outputs a caller does not select are pruned by the optimizer.
    """
    lexicons = json.dumps({
        "default_source": default_source, "remote_types": remote_types, "employment_types": employment_types,
        "seniority_levels": seniority_levels, "skills": skills, "aliases": aliases, "ignored_tags": ignored_tags,
        "snippet_length": snippet_length,
    })
    application = listings.sparkSession.sparkContext.applicationId
    stages = _expressions(application, lexicons)
    cleaned, *middle, records = stages
    records = records | {"freshness_days": times.freshness_days(F.col("posted_at"), as_of)}
    carried = [name for name in listings.columns if name not in RAW_FIELDS]
    usable = (listings if where is None else listings.filter(where)).filter(~times.epoch_out_of_range(F.col("posted_at_raw")))
    if wanted is not None:
        usable = _possible(usable, wanted, json.loads(lexicons), stages)
    staged = usable.select(*carried, *RAW_FIELDS, *(value.alias(name) for name, value in cleaned.items()))
    for stage in middle:
        staged = staged.withColumns(stage)
    return evaluate_once(staged.select(
        *(records[name].alias(name) if name in records else name for name in JOB_FIELDS), *carried
    ))


def job_columns(jobs: DataFrame, order_columns: list[str] = ORDER_COLUMNS) -> DataFrame:
    """The fixed job schema followed by the order columns that are present."""
    return jobs.select(*JOB_FIELDS, *(name for name in order_columns if name in jobs.columns))
