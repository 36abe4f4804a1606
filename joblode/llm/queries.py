"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblode.llm import (
    bpe, collocations, embedding_dedup, exact_dedup, langid, line_rules, mixing, near_dedup, ngram_lm, periodic, pii, sharding, warc,
)
from joblode.llm.common import doc_remainder, table

VOCABULARY = "byte_bpe_50k.tiktoken"
SHARDS = 40
MIX_SEED, MIX_SHARE, MIX_EPOCHS = 11, 0.6, 3
#: (level, domain, lang, source, weight); all other nodes weigh 1.
MIX_WEIGHTS = [
    (1, "d0", None, None, 6.0), (1, "d1", None, None, 3.0), (1, "d2", None, None, 1.0),
    (2, "d0", "en", None, 2.0), (2, "d1", "en", None, 4.0), (2, "d2", "es", None, 5.0),
    (3, "d0", "en", "src0", 8.0), (3, "d1", "fr", "src1", 0.5), (3, "d2", "de", "src2", 0.0),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text."""
    return bpe.tokenize(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of texts and the document that stays."""
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back; pages carry no time, so page_id seconds after 2020 stand in for it."""
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages, F.lit(1577836800) + F.col("page_id")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "captured", "url_key", "position"
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between embeddings."""
    return embedding_dedup.find_near(table(spark, sf_dir, "embeddings")).drop("linkable")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from two thirds of the labelled documents."""
    docs = table(spark, sf_dir, "documents")
    held_out = doc_remainder("doc_id", 3) == 1
    rows = langid.identify(docs.select("doc_id", "text", "lang"), learn_from=~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into shards."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every text."""
    return ngram_lm.score(table(spark, sf_dir, "documents"), doc_remainder("doc_id", 5) == 1)


def domain() -> Column:
    """Domain of a source, by its last character."""
    return F.concat(F.lit("d"), (F.ascii(F.right("source", F.lit(1))) % 3).cast("string"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    weights = spark.createDataFrame(MIX_WEIGHTS, mixing.WEIGHTS)
    return mixing.select_mix(table(spark, sf_dir, "documents"), weights, MIX_SHARE, MIX_EPOCHS, MIX_SEED, domain=domain())


def disturbed(doc_id: Column, text: Column) -> Column:
    """The text, with a stretch repeated to its end in a tenth of the documents (by crc32 of the id)."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    h = F.crc32(doc_id.cast("string").cast("binary"))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    period = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    copies = F.ceil((n - a) / period)
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, period.cast("int")), copies.cast("int"))), F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every text, a tenth of the texts made to repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", disturbed(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return periodic.find_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text, two plain rules, and the share of words that the line field marks as content."""
    docs = table(spark, sf_dir, "documents")
    field = line_rules.learn(docs, table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return line_rules.label_lines(docs, field).withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("content_share") >= line_rules.KEEP_SHARE)).alias("kept"), "n_lines", "n_content_lines", "content_share",
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of two to five words of each language, by how far they exceed their parts."""
    return collocations.mine(table(spark, sf_dir, "documents")).drop("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_sharding": op8_sharding,
    "op9_lm_scores": op9_lm_scores,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_rules": op12_quality_rules,
    "op13_collocations": op13_collocations,
}


def _mix_sql() -> str:
    rows = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in MIX_WEIGHTS)
    paths = ["concat_ws('/', " + ", ".join(f"coalesce('=' || {c}, 'null')" for c in mixing.LEVELS[:k]) + ")" for k in (1, 2, 3)]
    head = f"""
    WITH w(level, domain, lang, source, weight) AS (VALUES {rows}),
    d AS (SELECT doc_id, 'd' || ascii(right(source, 1)) % 3 AS domain, lang, source,
          len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS n_tokens FROM documents),
    l AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS supply, {paths[0]} AS p1, {paths[1]} AS p2, {paths[2]} AS p3 FROM d GROUP BY domain, lang, source),
    n0 AS (SELECT l.*, '' AS p0,
      coalesce((SELECT weight FROM w WHERE level = 1 AND {paths[0]} = p1), 1.0)::DOUBLE AS w1,
      coalesce((SELECT weight FROM w WHERE level = 2 AND {paths[1]} = p2), 1.0)::DOUBLE AS w2,
      coalesce((SELECT weight FROM w WHERE level = 3 AND {paths[2]} = p3), 1.0)::DOUBLE AS w3 FROM l),
    n AS (SELECT *, CASE WHEN w1 > 0 AND w2 > 0 AND w3 > 0 THEN supply * {MIX_EPOCHS} ELSE 0 END AS cap FROM n0),
    b0 AS (SELECT p0, least(floor(sum(supply) * {MIX_SHARE}::DOUBLE), sum(cap)) AS budget FROM n GROUP BY p0)"""
    for k in (1, 2, 3):
        head += f""",
    t{k} AS (SELECT c.*, b.budget, c.cap / c.weight AS height FROM
      (SELECT p{k}, p{k - 1}, w{k} AS weight, sum(cap) AS cap FROM n GROUP BY ALL HAVING sum(cap) > 0) c JOIN b{k - 1} b USING (p{k - 1})),
    u{k} AS (SELECT *, (budget - (sum(cap) OVER (PARTITION BY p{k - 1} ORDER BY height, p{k} ROWS UNBOUNDED PRECEDING) - cap))
      / sum(weight) OVER (PARTITION BY p{k - 1} ORDER BY height DESC, p{k} DESC ROWS UNBOUNDED PRECEDING) AS water FROM t{k}),
    b{k} AS (SELECT p{k}, CASE WHEN height <= water THEN cap ELSE greatest((min({{'h': height, 'p': p{k}, 'w': water}})
      FILTER (WHERE height > water) OVER (PARTITION BY p{k - 1})).w, 0) * weight END AS budget FROM u{k})"""
    return head + f""",
    plan AS (SELECT n.domain, n.lang, n.source, supply, floor(coalesce(budget, 0) + 1e-6)::BIGINT AS target FROM n LEFT JOIN b3 USING (p3)),
    e AS (SELECT d.*, target, supply::BIGINT AS supply, CASE WHEN supply > 0 THEN target // supply::BIGINT ELSE 0 END AS whole FROM d JOIN plan p
      ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
    k AS (SELECT *, md5('{MIX_SEED}-' || (whole + 1) || '-' || doc_id) AS key FROM e),
    c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto FROM k)
    SELECT doc_id, domain, lang, source, n_tokens, target,
      CASE WHEN n_tokens > 0 THEN whole + (upto <= target - whole * supply)::INT ELSE 0 END::BIGINT AS copies FROM c"""


#: crc32 of the decimal doc_id, byte by byte and bit by bit.
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
      lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295::BIGINT))"""

_RUNS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS ws, {_CRC_SQL} AS h FROM documents),
    e AS (SELECT *, len(ws) AS n, (h // 10) % len(ws) AS a, 1 + (len(ws) - (h // 10) % len(ws)) // (3 + (h // 10) % 8) AS p FROM d WHERE len(ws) > 0),
    t AS (SELECT rid, n, unnest(range(n)) AS i, unnest(CASE WHEN h % 10 = 0
        THEN list_transform(range(n), lambda j: ws[CASE WHEN j < a THEN j ELSE a + (j - a) % p END + 1]) ELSE ws END) AS w FROM e),
    m AS (SELECT x.rid, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.rid = y.rid AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
    s AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS g FROM m)
      GROUP BY rid, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
    r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
    b AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
      first({{'s': start, 'l': length, 'p': period}} ORDER BY length DESC, start, period) AS best FROM r GROUP BY rid),
    c AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS body FROM t
      WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY rid)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
      sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
    FROM d LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)"""

_PHRASES_SQL = """
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM p),
    k AS (SELECT unnest(range(1, 6)) AS k),
    g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, k WHERE len(ws) >= k),
    f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
    c AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
    s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n.n,
        ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM c
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(v[1 : cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(v[cut + 1 : c.k], ' ') JOIN n ON n.lang = c.lang),
    best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM s),
    inside AS (SELECT lang, array_to_string(v[i : j], ' ') AS phrase, max(a) AS longer FROM (SELECT DISTINCT lang, a, k, v FROM c), 
      (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL),
    o AS (SELECT b.lang, b.phrase, b.a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
      FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE place = 1 AND coalesce(longer < b.a, true))
    SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000"""

ORACLE: dict[str, str] = {
    "op11_periodic_runs": _RUNS_SQL,
    "op13_collocations": _PHRASES_SQL,
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
        FROM d JOIN g USING (body)""",
    "op3_warc": """
        WITH u AS (SELECT page_id, coalesce(html, '') AS body, lower(trim(url)) AS url FROM pages),
        k AS (SELECT page_id, body, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
          regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?[^#]+') AS query, url FROM u),
        p AS (SELECT page_id, body, CASE WHEN coalesce(url, '') = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',')
          || ')' || coalesce(nullif(path, ''), '/') || query END AS url_key FROM k),
        g AS (SELECT body, max(page_id) AS keep FROM p WHERE strlen(body) >= 1000 GROUP BY body)
        SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
          CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id < keep THEN keep END AS refers_to, 1577836800 + page_id AS captured,
          url_key, row_number() OVER (ORDER BY url_key, 1577836800 + page_id, page_id) AS position FROM p LEFT JOIN g USING (body)""",
    "op10_mixing": _mix_sql(),
}
