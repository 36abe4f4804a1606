"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions.text import blank_to_null, join_present


def short_hash(text: Column, size: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def job_id(source: Column, source_job_id: Column, valid_url: Column) -> Column:
    seed = F.concat(source, F.lit(":"), source_job_id, F.lit(":"), F.coalesce(valid_url, F.lit("")))
    return short_hash(seed, 24)


def fallback_source_job_id(valid_url: Column, *raw_parts: Column) -> Column:
    """Identifier for listings whose source exposes none, from every descriptive part that is present."""
    seed = F.coalesce(
        blank_to_null(join_present(" | ", valid_url, *raw_parts)), F.lit(lexicon.MISSING_SOURCE_ID)
    )
    return short_hash(seed, 16)
