"""From raw documents to token ids: language ID, exact dedup, near dedup, mixing, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.llm import bpe, exact_dedup, langid, mixing, near_dedup
from joblode.llm.common import doc_remainder, drop_folder, fresh_prefix, scratch, with_columns_of
from joblode.llm.queries import domain
from joblode.session import ship_package

MIN_SCORE = 0.5
ARROW_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
MIX_SHARE, MIX_SEED = 0.9, 11
#: (level, domain, lang, source, weight); all other nodes weigh 1.
MIX_WEIGHTS = [(1, "d0", None, None, 2.0)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays unclear (posterior under MIN_SCORE)."""
    ship_package(spark)
    prefix = fresh_prefix(docs, "lang_pred", "score")
    rows = langid.identify(docs, learn_from=doc_remainder("doc_id", 3) != 1, prefix=prefix)
    good = (F.col(f"{prefix}lang_pred") != langid.UNKNOWN) & (F.col(f"{prefix}score") >= MIN_SCORE)
    return with_columns_of(rows.where(good), docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share at least 0.8 of their five-word shingles the smallest doc_id stays."""
    ship_package(spark)
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A share of all tokens, by the weights of domains, languages and sources; one epoch at most."""
    weights = spark.createDataFrame(MIX_WEIGHTS, mixing.WEIGHTS)
    return mixing.keep_mix(docs, weights, MIX_SHARE, MIX_SEED, domain())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and the digest of their bytes when decoded again."""
    ship_package(spark)
    return bpe.tokenize(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        keep=("doc_id", "lang", "source"), outputs=("n_tokens", "token_ids", "decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language ID, signatures and token ids have no SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written and read again for the next.

    Whole texts go through Python in Arrow batches, so batches are bounded by rows and bytes while the stages run. A
    stage's table is deleted when the one behind it is complete.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    saved = {key: spark.conf.get(key, None) for key in ARROW_BOUNDS}
    for key, value in ARROW_BOUNDS.items():
        spark.conf.set(key, value)
    try:
        for name, stage in STAGES:
            path = scratch(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                drop_folder(spark, before)
            before = path
    finally:
        for key, value in saved.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return docs
