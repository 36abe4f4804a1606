"""The pipeline, stage by stage, against plain versions on a small table."""

from collections import Counter

import public_tokenizers
import pytest
from test_corpus_operators import plain_classes, plain_copies, plain_mix, row_name, sample_docs, text

import corpus_pipeline
from joblode.llm import bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "lang_pred", "_Score", "copy_key", "keep_id", "gone_id", "class_id", "n_tokens", "token_ids", "key", "id", "domain", "copies"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows = sample_docs() + [(600 + i, text(i % 50, 40 + i % 9), "en", f"src{i % 5}") for i in range(80)]
    rows += [(800, "1234 5678", "en", "src0")]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def plain(rows):
    return [tuple(r)[:4] for r in rows]


def test_stages(spark, sf_dir):
    tiktoken = pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    rows = {None: docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        rows[name] = docs.collect()

    with_letters = [r for r in plain(rows[None]) if any(c.isalpha() for c in r[1] or "")]
    assert Counter(plain(rows["language_id"])) <= Counter(with_letters) and len(rows["language_id"]) > 0.9 * len(with_letters)

    before = plain(rows["language_id"])
    assert {(r[0], r[1]) for r in plain(rows["exact_dedup"])} == {(k, r[1]) for r, (_, k, *_) in zip(before, plain_copies(before), strict=True)}

    before = plain(rows["exact_dedup"])
    classes = plain_classes(before)
    assert Counter(plain(rows["near_dedup"])) == Counter(r for r in before if r[0] is None or classes[r[0]] == r[0])

    before = plain(rows["near_dedup"])
    mixed = plain_mix(
        [(*r, "d" + str(ord(r[3][-1]) % 3) if r[3] else None) for r in before], corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_SHARE, 1, corpus_pipeline.MIX_SEED
    )
    chosen = {n for (n, _, _, copies), _ in mixed.items() if copies}
    assert Counter(plain(rows["mixing"])) == Counter(r for r in before if row_name(r[0], r[1]) in chosen)
    assert 0 < len(rows["mixing"]) < len(before)

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r[0]: library.encode_ordinary(r[1]) for r in plain(rows["mixing"])}
    assert {r.doc_id: list(r.token_ids) for r in rows["bpe"]} == want

    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in final) == Counter((r.doc_id, tuple(r.token_ids)) for r in rows["bpe"])


def test_stages_leave_columns_with_clashing_names_alone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *(f"coalesce(doc_id, -1) * 100 + {i} AS `{c}`" for i, c in enumerate(CLASHES)))
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        if name != "bpe":
            assert docs.columns == columns and docs.count()
            for row in docs.collect():
                assert all(row[c] == (-1 if row.doc_id is None else row.doc_id) * 100 + i for i, c in enumerate(CLASHES))


def test_run_decodes_and_cleans_up(spark, sf_dir):
    import hashlib
    from pathlib import Path

    from joblode.session import shared_folder

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("pipeline-near_dedup-*"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == []
