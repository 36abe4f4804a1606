"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Arrival order is data: precedence of the source, the payload, and the place inside it.
ORDER_COLUMNS = ["src_rank", "payload_id", "pos"]

RAW_FIELDS = [
    "source", "source_job_id", "source_job_url", "title", "company", "location_raw", "salary_text",
    "description_text", "tags", "posted_at_raw", "employment_type_raw", "remote_type_raw",
]

JOB_FIELDS = [
    "id", "source", "source_job_id", "source_job_url", "language", "title", "normalized_title", "company",
    "location_raw", "location_city", "location_country", "remote_type", "employment_type",
    "seniority_level", "salary_text", "description_snippet", "skills", "posted_at", "freshness_days",
]

AUDIT_COLUMNS = ["created_at", "updated_at", "last_seen_at"]

# Insert order of a stored row, stable across updates.
STORED_ORDER_COLUMNS = ["insert_batch", *ORDER_COLUMNS]

PAYLOADS = T.StructType([
    T.StructField("payload_id", T.StringType(), False),
    *_strings("source", "url", "body", "payload_type"),
    T.StructField("src_rank", T.IntegerType()),
])

def _job_field(name: str) -> T.StructField:
    special = {
        "skills": T.ArrayType(T.StringType()),
        "posted_at": T.TimestampType(),
        "freshness_days": T.IntegerType(),
    }
    return T.StructField(name, special.get(name, T.StringType()))


JOB = T.StructType([_job_field(name) for name in JOB_FIELDS])

STORED_JOB = T.StructType([
    *JOB.fields,
    T.StructField("insert_batch", T.LongType()),
    T.StructField("src_rank", T.IntegerType()),
    T.StructField("payload_id", T.StringType()),
    T.StructField("pos", T.LongType()),
    *(T.StructField(name, T.TimestampType()) for name in AUDIT_COLUMNS),
])

CANDIDATES = T.StructType([
    T.StructField("candidate_id", T.LongType()),
    T.StructField("skills", T.ArrayType(T.StringType())),
    T.StructField("experience_years", T.IntegerType()),
    T.StructField("preferred_location", T.StringType()),
    T.StructField("remote_preferred", T.BooleanType()),
])
