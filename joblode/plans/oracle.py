"""DuckDB SQL for the registered queries, written from the definitions rather than from the Spark code."""

from __future__ import annotations

from joblode import lexicon
from joblode.plans.listing_view import HOST_LETTERS, LISTING_SQL

AS_OF = "DATE '2026-03-22'"

# Every whitespace character, for an engine whose \s is ASCII only.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _clean(column: str) -> str:
    return f"nullif(trim(regexp_replace({column}, {_text(_SPACES)}, ' ', 'g')), '')"


def _labels(column: str, table: dict[str, list[str]]) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({column}, {_text(rf'\b({"|".join(entries)})\b')}, 'i') THEN {_text(label)}"
        for label, entries in table.items()
    )
    return f"CASE {cases} END"


def _escaped(word: str) -> str:
    return word.replace(".", r"\.")


def _text_skills(column: str) -> str:
    spellings = {name: list(words) for name, words in lexicon.SKILLS.items()}
    for alias, name in lexicon.SKILL_ALIASES.items():
        spellings[name].append(alias)
    return ", ".join(
        f"CASE WHEN regexp_matches({column}, {_text(rf'\b({"|".join(map(_escaped, words))})\b')}, 'i') "
        f"THEN {_text(name)} END"
        for name, words in spellings.items()
    )


def _tag_case(tag: str) -> str:
    ignored = ", ".join(_text(word) for word in lexicon.IGNORED_TAGS)
    renamed = {w: name for name, words in lexicon.SKILLS.items() for w in words if w != name}
    renamed |= lexicon.SKILL_ALIASES
    cases = " ".join(f"WHEN {tag} = {_text(word)} THEN {_text(name)}" for word, name in renamed.items())
    return f"CASE WHEN {tag} IN ({ignored}) THEN NULL {cases} ELSE {tag} END"


def _title_word(word: str, index: str) -> str:
    acronyms = " ".join(f"WHEN lower({word}) = {_text(k)} THEN {_text(v)}" for k, v in lexicon.TITLE_ACRONYMS.items())
    small = ", ".join(_text(item) for item in lexicon.TITLE_SMALL_WORDS)
    return (
        f"CASE {acronyms} WHEN {index} > 1 AND lower({word}) IN ({small}) THEN lower({word}) "
        f"WHEN {word} = lower({word}) OR {word} = upper({word}) "
        f"THEN upper(left({word}, 1)) || lower(substr({word}, 2)) ELSE {word} END"
    )


_BRACKET = rf"[(\[{{][^)\]}}]*\b({'|'.join(lexicon.TITLE_BRACKET_WORDS)})\b[^)\]}}]*[)\]}}]"


def _replace(column: str, pattern: str) -> str:
    return f"regexp_replace({column}, {_text(pattern)}, ' ', 'gi')"


def _core(column: str) -> str:
    core = _replace(column, _BRACKET)
    core = _replace(core, r"\s*\|\s*")
    core = _replace(core, r"\s[-/]\s")
    for word in lexicon.TITLE_NOISE_WORDS:
        core = _replace(core, rf"\b({word})\b")
    core = _replace(core, r"[()\[\]{},;:]+")
    return f"trim({_replace(core, r'\s+')}, ' -_/')"


def _normal_title(column: str) -> str:
    words = f"list_transform(string_split({_core(column)}, ' '), lambda w, i: {_title_word('w', 'i')})"
    return f"coalesce(nullif(array_to_string({words}, ' '), ''), {column})"


def _source_rank(column: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {column} = {_text(name)} THEN {rank}" for rank, (name, _, _) in enumerate(lexicon.SOURCES)
    ) + " END"


LISTINGS = f"""lv AS ({LISTING_SQL}),
raw AS (
  SELECT lv.*, {_source_rank('source')} AS src_rank, seq AS pos,
    list_filter(list_transform(string_split(tags_csv, ','), lambda t: trim(t)), lambda t: t <> '') AS tags,
    CASE WHEN regexp_matches(source_job_url, '^HTTPS')
         THEN 'https://jobs.example.com' || substr(source_job_url, 25) ELSE source_job_url END AS valid_url
  FROM lv
)"""

_PLACE = "lower(location_raw)"
_PLACELESS = " OR ".join(f"contains({_PLACE}, {_text(word)})" for word in lexicon.PLACELESS_WORDS)
_PARTS = "list_filter(list_transform(string_split(location_raw, ','), lambda p: trim(p)), lambda p: p <> '')"

JOBS = f"""{LISTINGS},
described AS (
  SELECT raw.*, title || ' ' || description_text AS role_text,
    concat_ws(' ', title, description_text, location_raw, employment_type_raw, remote_type_raw,
              nullif(array_to_string(tags, ' '), '')) AS evidence,
    coalesce(source_job_id, substr(sha256(substr(concat_ws(' | ', valid_url, source_job_url, company, title,
              location_raw, posted_at_raw), 1)), 1, 16)) AS job_key,
    CASE WHEN posted_at_raw = 'not-a-date' THEN NULL
         WHEN posted_at_raw = '1774000000' THEN TIMESTAMP '2026-03-20 09:46:40'
         ELSE CAST(substr(posted_at_raw, 1, 10) || ' ' || substr(posted_at_raw, 12, 8) AS TIMESTAMP) - INTERVAL 2 HOUR
    END AS posted
  FROM raw
),
jobs AS (
  SELECT substr(sha256(source || ':' || job_key || ':' || coalesce(valid_url, '')), 1, 24) AS id,
    source, job_key AS source_job_id, valid_url AS source_job_url,
    CASE WHEN regexp_matches(title, '[{lexicon.TURKISH_LETTERS}]') THEN 'tr' ELSE 'en' END AS language,
    title, {_normal_title('title')} AS normalized_title, company, location_raw,
    CASE WHEN NOT ({_PLACELESS}) THEN ({_PARTS})[1] END AS location_city,
    CASE WHEN NOT ({_PLACELESS}) AND len({_PARTS}) >= 2 THEN ({_PARTS})[len({_PARTS})] END AS location_country,
    {_labels('evidence', lexicon.REMOTE_TYPES)} AS remote_type,
    {_labels('evidence', lexicon.EMPLOYMENT_TYPES)} AS employment_type,
    {_labels('evidence', lexicon.SENIORITY_LEVELS)} AS seniority_level,
    description_text AS description_snippet,
    list_sort(list_distinct(list_filter(list_concat(
      list_transform(tags, lambda t: {_tag_case('lower(t)')}), [{_text_skills('role_text')}]), lambda s: s IS NOT NULL))) AS skills,
    posted AS posted_at,
    CAST(greatest(date_diff('day', CAST(posted AS DATE), {AS_OF}), 0) AS INTEGER) AS freshness_days,
    posted IS NULL AS undated, src_rank, order_key, pos
  FROM described
),
dated AS (SELECT * REPLACE (CASE WHEN undated THEN NULL ELSE freshness_days END AS freshness_days) FROM jobs)"""

_SKILLS = "array_to_string(skills, ',')"
_ARRIVAL = "src_rank, order_key, pos"
_STORED_ORDER = f"freshness_days ASC NULLS LAST, title ASC NULLS FIRST, {_ARRIVAL}"
_SEARCH_ORDER = f"freshness_days ASC NULLS LAST, lower(coalesce(title, '')), {_ARRIVAL}"
_HIT = "id, title, company, location_raw, remote_type, employment_type, seniority_level, freshness_days"
_QUERY_TEXT = f"lower(concat_ws(' ', title, normalized_title, company, description_snippet, nullif(array_to_string(skills, ' '), '')))"
_WHERE_TEXT = "lower(concat_ws(' ', location_raw, location_city, location_country))"
_TURKEY = " OR ".join(f"contains(' ' || {_WHERE_TEXT} || ' ', {_text(marker)})" for marker in lexicon.TURKEY_MARKERS)


def _stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def _jobs(select: str) -> str:
    return f"WITH {JOBS} {select}"


def _canonical(column: str) -> str:
    head = rf"regexp_extract({column}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+')"
    path = f"rtrim(regexp_extract(substr({column}, length({head}) + 1), '^[^?#]*'), '/')"
    query = f"regexp_extract(regexp_replace({column}, '#.*$', ''), '\\?.+$')"
    return (
        f"nullif(CASE WHEN {head} <> '' THEN lower({head}) || {path} || {query} "
        f"ELSE lower(rtrim(trim({column}), '/')) END, '')"
    )


def _counted(named: str, limit: int, extra: str = "") -> str:
    """`named` selects name, ord (place of the row in stored order) and place."""
    return f"""(SELECT name, count(*) AS "count"{extra} FROM ({named}) WHERE name IS NOT NULL
  GROUP BY name ORDER BY count(*) DESC, min(ord * 1000 + place) LIMIT {limit})"""


def _top(named: str, limit: int) -> str:
    return _jobs(f", placed AS (SELECT *, row_number() OVER (ORDER BY {_STORED_ORDER}) AS ord FROM dated) {_counted(named, limit)}")


def _search(where: str, offset: int, limit: int = 50) -> str:
    return _jobs(f"SELECT {_HIT} FROM dated WHERE {where} ORDER BY {_SEARCH_ORDER} LIMIT {limit} OFFSET {offset}")


def _in_batch(batch: str, value: str) -> str:
    return f"CASE WHEN {batch} = 0 THEN '2026-03-22 09:00:00' ELSE '2026-03-23 11:30:00' END AS {value}"


_MERGED = f"""
, arrived AS (SELECT *, coalesce('url ' || source_job_url, 'id ' || id) AS ident,
    row_number() OVER (ORDER BY order_key % 2, {_ARRIVAL}) AS arrival, order_key % 2 AS batch FROM dated),
merged AS (SELECT arg_min(id, arrival) AS id, arg_max(source, arrival) AS source,
    arg_max(source_job_id, arrival) AS source_job_id, max(source_job_url) AS source_job_url,
    arg_max(title, arrival) AS title, arg_max({_SKILLS}, arrival) AS skills, min(batch) AS born, max(batch) AS seen,
    arg_max(company, arrival) AS company, arg_max(location_raw, arrival) AS location_raw, arg_max(skills, arrival) AS skill_list,
    arg_max(coalesce(freshness_days, -1), arrival) AS age, min(arrival) AS first_arrival
  FROM arrived GROUP BY ident),
kept AS (SELECT *, nullif(age, -1) AS freshness_days,
    row_number() OVER (ORDER BY nullif(age, -1) ASC NULLS LAST, title ASC NULLS FIRST, first_arrival) AS ord FROM merged)"""

_UPSERT = _jobs(f"""{_MERGED}
SELECT id, source, source_job_id, source_job_url, title, skills,
  {_in_batch('born', 'created_at')}, {_in_batch('seen', 'updated_at')}, {_in_batch('seen', 'last_seen_at')}
FROM merged""")

_ROW = "{'id': %s, 'url': url, 'title': title, 'born': %s, 'seen': batch}"
#: One record of every order in each step; state holds the rows of an order from the oldest on.
_REPLAY = f"""
WITH RECURSIVE lv AS ({LISTING_SQL}),
made AS (SELECT order_key, title, 'j' || order_key || '-' || (split_part(seq, '-', 3)::BIGINT % 3) AS id,
    CASE WHEN split_part(seq, '-', 2)::BIGINT % 4 > 0
      THEN 'https://jobs.example.com/o/' || order_key || '/' || (split_part(seq, '-', 2)::BIGINT % 4) END AS url,
    CASE WHEN split_part(seq, '-', 4)::BIGINT <= 3 THEN 0 ELSE 1 END AS batch, seq, {_source_rank('source')} AS src_rank FROM lv),
line AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY batch, src_rank, seq) AS step FROM made),
state AS (
  SELECT DISTINCT order_key, 0::BIGINT AS step, []::STRUCT(id VARCHAR, url VARCHAR, title VARCHAR, born INTEGER, seen INTEGER)[] AS jobs FROM line
  UNION ALL
  SELECT order_key, step, CASE WHEN hit > 0
    THEN list_transform(jobs, lambda x, i: CASE WHEN i = hit THEN {_ROW % ('x.id', 'x.born')} ELSE x END)
    ELSE list_append(jobs, {_ROW % ('id', 'batch')}) END
  FROM (SELECT s.order_key, l.step, s.jobs, l.id, l.url, l.title, l.batch, CASE
      WHEN l.url IS NOT NULL AND list_position(list_transform(s.jobs, lambda x: x.url), l.url) > 0
      THEN list_position(list_transform(s.jobs, lambda x: x.url), l.url)
      ELSE coalesce(list_position(list_transform(s.jobs, lambda x: x.id), l.id), 0) END AS hit
    FROM state s JOIN line l ON l.order_key = s.order_key AND l.step = s.step + 1))
SELECT j.id, j.url AS source_job_url, j.title, {_in_batch('j.born', 'created_at')}, {_in_batch('j.seen', 'updated_at')}
FROM (SELECT order_key, unnest(arg_max(jobs, step)) AS j FROM state GROUP BY order_key)"""


def _dollars(amount: str) -> str:
    return f"'$' || format('{{:,}}', {amount})"


_LISTED = f"""
SELECT source, source_job_id, source_job_url, title, company, location_raw, salary_text, description_text,
  posted_at_raw, employment_type_raw, remote_type_raw, tags
FROM (SELECT *, row_number() OVER (PARTITION BY src_rank, payload, coalesce(source_job_id, source_job_url,
        company || '::' || title) ORDER BY seq) AS place FROM mapped) WHERE place = 1"""

_JSON = f"""WITH {LISTINGS},
mapped AS (
  SELECT seq, src_rank, order_key // 8 AS payload, CASE WHEN source <> 'kariyer' THEN source END AS source,
    CASE WHEN source = 'kariyer' THEN source_job_id ELSE coalesce(source_job_id, source_job_url) END AS source_job_id,
    source_job_url, title, company, location_raw,
    CASE WHEN source = 'kariyer' THEN
      CASE WHEN order_key % 5 > 0 AND order_key % 3 > 0
           THEN {_dollars('order_key % 5 * 10000')} || ' - ' || {_dollars('order_key % 3 * 25000')}
           WHEN order_key % 5 > 0 THEN {_dollars('order_key % 5 * 10000')} || '+'
           WHEN order_key % 3 > 0 THEN 'Up to ' || {_dollars('order_key % 3 * 25000')} END END AS salary_text,
    description_text, posted_at_raw,
    CASE WHEN source <> 'kariyer' THEN employment_type_raw END AS employment_type_raw,
    CASE source WHEN 'arbeitnow' THEN CASE WHEN location_raw = 'Remote' THEN 'remote' ELSE 'onsite' END
      WHEN 'themuse' THEN CASE WHEN location_raw = 'Remote' THEN 'remote' END ELSE 'remote' END AS remote_type_raw,
    CASE WHEN source = 'themuse' THEN '' ELSE array_to_string(tags, ',') END AS tags
  FROM raw
){_LISTED}"""

_CARDS = f"""WITH {LISTINGS}
SELECT 'kariyer' AS source, 'https://www.kariyer.net/is-ilani/' || CAST(seq AS VARCHAR) AS source_job_id,
  'https://www.kariyer.net/is-ilani/' || CAST(seq AS VARCHAR) AS source_job_url, title, company, location_raw
FROM raw"""

_ROWS = f"""WITH {LISTINGS}
SELECT source, CAST(seq AS VARCHAR) AS source_job_id,
  regexp_replace(source_job_url, '^HTTPS', 'https') AS source_job_url, title, company, location_raw,
  CAST(NULL AS VARCHAR) AS salary_text, description_text, posted_at_raw, CAST(NULL AS VARCHAR) AS employment_type_raw,
  CAST(NULL AS VARCHAR) AS remote_type_raw, array_to_string(tags, ',') AS tags
FROM raw"""

_INGESTED = f"""WITH {LISTINGS},
fed AS (
  SELECT * REPLACE (
    CASE WHEN source = 'kariyer' THEN {_text(lexicon.DEFAULT_SOURCE)} ELSE source END AS source,
    CASE WHEN source = 'kariyer' THEN source_job_id ELSE coalesce(source_job_id, source_job_url) END AS source_job_id,
    CASE WHEN source <> 'kariyer' THEN employment_type_raw END AS employment_type_raw,
    CASE source WHEN 'arbeitnow' THEN CASE WHEN location_raw = 'Remote' THEN 'remote' ELSE 'onsite' END
      WHEN 'themuse' THEN CASE WHEN location_raw = 'Remote' THEN 'remote' END ELSE 'remote' END AS remote_type_raw,
    CASE WHEN source = 'themuse' THEN [] ELSE tags END AS tags, order_key // 8 AS order_key,
    row_number() OVER (PARTITION BY src_rank, order_key // 8 ORDER BY seq) - 1 AS pos) FROM raw),
once AS (SELECT *, {_canonical('source_job_url')} AS place FROM fed QUALIFY row_number() OVER (PARTITION BY src_rank, order_key,
    coalesce(source_job_id, source_job_url, company || '::' || title) ORDER BY pos) = 1),
found AS (SELECT * FROM once QUALIFY place IS NULL OR row_number() OVER (PARTITION BY place ORDER BY src_rank, order_key, pos) = 1),
{JOBS.removeprefix(LISTINGS).lstrip(chr(44)).strip().replace('FROM raw', 'FROM found').replace('raw.*', 'found.*')}"""

_LANDED = """WITH e AS (SELECT *, event_id // 1000 AS part, event_id % 2 AS odd FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY odd, part ORDER BY event_id) - 1 AS pos FROM e),
ranks AS (SELECT 0 AS odd, {known} AS src_rank UNION ALL SELECT 1, {unknown})
SELECT src_rank, pos, CASE WHEN event_id % 7 > 0 THEN CAST(event_id AS VARCHAR) END AS source_job_id,
  CASE WHEN event_id % 7 > 0 AND odd = 0 THEN event_type END AS title,
  CASE WHEN event_id % 7 = 0 THEN 'record_not_object' END AS reject_reason
FROM placed JOIN ranks USING (odd) WHERE part % 5 <> 4
UNION ALL SELECT src_rank, NULL, NULL, NULL, 'payload_not_json' FROM (SELECT DISTINCT odd, part FROM e) JOIN ranks USING (odd)
WHERE part % 5 = 4""".format(
    known=[name for name, _, _ in lexicon.SOURCES].index("remotive"), unknown=len(lexicon.SOURCES)
)

_VISIBLE = (
    r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), "
    r"'(?is)<(script|style)\b.*?</(script|style)\s*>', ' ', 'g'), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')"
)

_PAGE_TEXT = _clean(
    f"regexp_replace(replace(replace(replace({_VISIBLE}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;?', '&', 'g')"
)
_PAGE_LINK = (
    "regexp_extract(url, '^[a-z]+://[^/?#]+') || "
    """replace(regexp_extract(html, '<a href="([^"]*)"', 1), '&amp;', '&')"""
)

_CANDIDATES = """candidates AS (
  SELECT c_custkey AS candidate_id,
    CASE c_custkey % 4 WHEN 0 THEN ['python', 'sql'] WHEN 1 THEN ['kubernetes', 'postgresql', 'python']
      WHEN 2 THEN ['node', 'typescript', 'java'] ELSE ['cobol'] END AS known,
    CASE c_custkey % 3 WHEN 0 THEN 'asia' WHEN 1 THEN 'istanbul' END AS wish,
    CASE WHEN c_custkey % 5 < 3 THEN c_custkey % 5 = 0 END AS remote_wish,
    CASE c_custkey % 3 WHEN 0 THEN 'python api engineer' WHEN 1 THEN 'data engineer' ELSE 'astronaut' END AS target
  FROM customer)"""

_MATCHED = f"""
, pool AS (SELECT *, row_number() OVER (ORDER BY {_STORED_ORDER}) AS place FROM dated QUALIFY place <= 100),
{_CANDIDATES},
offers AS (SELECT candidate_id, wish, remote_wish, unnest(known) AS skill FROM candidates),
wanted AS (SELECT id, place, remote_type, location_raw, unnest(skills) AS skill FROM pool),
pairs AS (SELECT candidate_id, place, id, count(*) AS shared_skills,
    max(coalesce(CAST(coalesce(remote_type IN ('remote', 'hybrid'), NULL) = remote_wish AS INTEGER), 0)) AS remote_fit,
    max(coalesce(CAST(contains(lower(location_raw), wish) AS INTEGER), 0)) AS place_fit
  FROM offers JOIN wanted USING (skill) GROUP BY candidate_id, place, id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY candidate_id
    ORDER BY shared_skills DESC, remote_fit DESC, place_fit DESC, place) - 1 AS r FROM pairs)"""

_MATCH = _jobs(f"""{_MATCHED}
SELECT candidate_id, CAST(r AS INTEGER) AS "rank", CAST(greatest(100 - 10 * r, 10) AS INTEGER) AS match_score,
  id AS job_id, shared_skills FROM ranked WHERE r < 5""")

_MATCH_ALL = _MATCH.replace("QUALIFY place <= 100", "")

_MATCH_RECORDS = _jobs(f"""{_MATCHED}
SELECT candidate_id, CAST(r AS INTEGER) AS "rank", CAST(greatest(100 - 10 * r, 10) AS INTEGER) AS match_score,
  id, title, company FROM ranked JOIN pool USING (id, place) WHERE r < 5""")

_GAP = f"""
, {_CANDIDATES},
demand AS (SELECT lower(normalized_title) AS target, skill, count(*) AS jobs
  FROM (SELECT normalized_title, unnest(skills) AS skill FROM dated) GROUP BY 1, 2),
wished AS (SELECT target, skill, CAST(sum(jobs) AS BIGINT) AS jobs
  FROM (SELECT DISTINCT target FROM candidates) t JOIN (SELECT target AS title, skill, jobs FROM demand) d ON contains(title, target) GROUP BY 1, 2),
gap AS (SELECT candidate_id AS request_id, skill, jobs FROM candidates JOIN wished USING (target)
  WHERE NOT list_contains(known, skill))"""

#: RFC 3492: one row for each inserted character, its difference, its bias and its digits.
_HOSTS = f"""WITH RECURSIVE lv AS ({LISTING_SQL}),
named AS (SELECT seq, source, substr('{HOST_LETTERS}', order_key % {len(HOST_LETTERS)} + 1, 1 + (order_key // {len(HOST_LETTERS)}) % 9) AS label FROM lv),
chars AS (SELECT label, nth, substr(label, nth, 1) AS c, unicode(substr(label, nth, 1))::BIGINT AS code
  FROM (SELECT DISTINCT label, unnest(range(1, length(label) + 1)) AS nth FROM named)),
plain AS (SELECT label, count(*) FILTER (code < 128) AS basics, coalesce(string_agg(c, '' ORDER BY nth) FILTER (code < 128), '') AS kept FROM chars GROUP BY label),
inserted AS (SELECT c.label, c.code, row_number() OVER (PARTITION BY c.label ORDER BY c.code, c.nth) AS r,
    (SELECT count(*) FROM chars o WHERE o.label = c.label AND o.nth < c.nth AND o.code <= c.code) AS spot
  FROM chars c WHERE c.code >= 128),
skips AS (SELECT label, r, basics + r AS points,
    (code - lag(code, 1, 128) OVER w) * (basics + r) + spot - lag(spot + 1, 1, 0) OVER w AS delta
  FROM inserted JOIN plain USING (label) WINDOW w AS (PARTITION BY label ORDER BY r)),
halved AS (SELECT *, CASE WHEN r = 1 THEN delta // 700 ELSE delta // 2 END AS x FROM skips),
adapted AS (SELECT label, r, x + x // points AS d, 0 AS k FROM halved
  UNION ALL SELECT label, r, d // 35, k + 36 FROM adapted WHERE d > 455),
biased AS (SELECT label, r, delta, lag(k + 36 * d // (d + 38), 1, 72) OVER (PARTITION BY label ORDER BY r) AS bias
  FROM adapted JOIN skips USING (label, r) WHERE d <= 455),
digits AS (SELECT label, r, delta AS q, 36 AS k, bias, '' AS said, false AS done FROM biased
  UNION ALL
  SELECT label, r, CASE WHEN q < t THEN q ELSE (q - t) // (36 - t) END, k + 36, bias,
    said || substr('abcdefghijklmnopqrstuvwxyz0123456789', (CASE WHEN q < t THEN q ELSE t + (q - t) % (36 - t) END + 1)::INTEGER, 1), q < t
  FROM (SELECT *, least(greatest(k - bias, 1), 26) AS t FROM digits WHERE NOT done)),
hosts AS (SELECT label, kept || CASE WHEN basics > 0 THEN '-' ELSE '' END || string_agg(said, '' ORDER BY r) AS coded
  FROM digits JOIN plain USING (label) WHERE done GROUP BY label, kept, basics),
urls AS (SELECT seq, source, 'https://' || coalesce('xn--' || coded, label) || '.example.com/p/' || seq AS url FROM named LEFT JOIN hosts USING (label))
SELECT seq AS pos, substr(sha256(source || ':' || seq || ':' || url), 1, 24) AS id, url AS source_job_url FROM urls"""

_RANKED = _jobs(f"""
, lists AS (SELECT order_key AS list_id, list(id ORDER BY pos) AS ids FROM dated GROUP BY order_key),
listed AS (SELECT list_id, unnest(ids) AS id, unnest(range(len(ids))) AS spot FROM lists),
firsts AS (SELECT list_id, id, min(spot) AS spot FROM listed GROUP BY list_id, id),
ranked AS (SELECT list_id, id, row_number() OVER (PARTITION BY list_id ORDER BY spot) - 1 AS r FROM firsts),
named AS (SELECT id, title FROM dated QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_rank DESC, order_key DESC, pos DESC) = 1)
SELECT list_id, CAST(r AS INTEGER) AS "rank", CAST(greatest(100 - 10 * r, 10) AS INTEGER) AS match_score, id, title
FROM ranked JOIN named USING (id) WHERE r < 5""")

_RESPONSES = """WITH made AS (
  SELECT o_orderkey AS response_id, o_orderkey % 8 AS form,
    CASE WHEN (o_orderkey // 8) % 5 = 0 THEN 'gap' WHEN o_orderkey % 8 < 3 THEN 'match' ELSE 'gap' END AS kind,
    o_orderpriority AS priority FROM orders),
judged AS (SELECT *, CASE WHEN form = 5 THEN 'empty_response' WHEN form IN (2, 6) THEN 'invalid_json'
    WHEN (form < 2) <> (kind = 'match') THEN 'unexpected_shape' WHEN form = 7 THEN 'invalid_analysis' END AS error_code
  FROM made)
SELECT response_id, kind,
  CASE WHEN error_code IS NULL AND kind = 'match' THEN 'job-' || CAST(response_id AS VARCHAR) || ',job-x' END AS job_ids,
  CASE WHEN error_code IS NULL AND kind = 'gap' THEN 'sql,' || priority END AS missing_skills,
  CASE WHEN error_code IS NULL AND kind = 'gap' THEN 'high' END AS learning_priority, error_code
FROM judged"""

_RATE_CAP = """WITH RECURSIVE seen AS (
  SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id ELSE -1 END AS user_id,
    CASE WHEN event_id % 101 <> 0 THEN epoch_us(ts) END AS us FROM events),
ordered AS (
  SELECT user_id, event_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n
  FROM seen WHERE us IS NOT NULL),
walk AS (
  SELECT user_id, event_id, n, 1 AS accepted, us AS newest, CAST(NULL AS BIGINT) AS older FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.n,
    CASE WHEN w.older IS NULL OR w.older <= o.us - 21600000000 THEN 1 ELSE 0 END,
    CASE WHEN w.older IS NULL OR w.older <= o.us - 21600000000 THEN o.us ELSE w.newest END,
    CASE WHEN w.older IS NULL OR w.older <= o.us - 21600000000 THEN w.newest ELSE w.older END
  FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT nullif(user_id, -1) AS user_id, event_id, accepted FROM walk
UNION ALL SELECT nullif(user_id, -1), event_id, 0 FROM seen WHERE us IS NULL"""

_PROFILES = """profiles AS (
  SELECT c_custkey AS candidate_id, c_custkey % 12 AS years,
    CASE c_custkey % 4 WHEN 0 THEN '["Python","sql"]' WHEN 1 THEN '["kubernetes","postgresql","python"]'
      WHEN 2 THEN '["node","typescript","java"]' ELSE '["cobol"]' END AS known,
    CASE c_custkey % 3 WHEN 0 THEN 'Asia' WHEN 1 THEN 'istanbul' ELSE 'not given' END AS place,
    CASE WHEN c_custkey % 5 = 0 THEN 'true' WHEN c_custkey % 5 < 3 THEN 'false' ELSE 'not given' END AS remote,
    CASE c_custkey % 3 WHEN 0 THEN 'Senior Python API engineer' WHEN 1 THEN 'data engineer (remote)' ELSE 'Astronaut' END AS target
  FROM customer)"""

_COMPACT = ", ".join(
    f"'{name}': {name}" for name in (
        "id", "title", "normalized_title", "company", "location_raw", "remote_type", "employment_type",
        "seniority_level", "skills", "language",
    )
)

_PROMPTS = _jobs(f"""
, {_PROFILES},
pool AS (SELECT *, row_number() OVER (ORDER BY {_STORED_ORDER}) AS place FROM dated QUALIFY place <= 100),
listed AS (SELECT '[' || string_agg(CAST(to_json({{{_COMPACT}}}) AS VARCHAR), ', ' ORDER BY place) || ']' AS jobs FROM pool)
SELECT candidate_id, 'Candidate skills: ' || known || chr(10) || 'Years of experience: ' || CAST(years AS VARCHAR) || chr(10)
  || 'Preferred location: ' || place || chr(10) || 'Prefers remote work: ' || remote || chr(10) || chr(10)
  || 'Open jobs: ' || jobs || chr(10) || chr(10)
  || 'Answer with a JSON array of the ids of the 5 best jobs, best first, and nothing else.' AS prompt
FROM profiles, listed""")

_GAP_PROMPTS = f"""WITH {_PROFILES}
SELECT candidate_id AS request_id, 'Known skills: ' || known || chr(10) || 'Target job title: ' || target || chr(10) || chr(10)
  || 'Answer with a JSON object and nothing else. Keys: missing_skills (array of strings), learning_priority (string), '
  || 'estimated_learning_time (string), recommended_resources (array of strings).' AS prompt
FROM profiles"""

_QUARANTINE = """
SELECT event_id AS payload_id, CAST(NULL AS BIGINT) AS pos, 'payload_not_json' AS reject_reason FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 0, 'record_not_object' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 1, 'record_not_object' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 2, 'no_usable_content' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, NULL, 'payload_not_json' FROM events WHERE event_type NOT IN ('error', 'click') AND event_id % 6 > 0"""

_STORED_INSIGHTS = _jobs(_MERGED + " " + " UNION ALL ".join(
        _counted(named, 15, f", '{name}' AS dimension") for name, named in {
            "skills": "SELECT unnest(skill_list) AS name, ord, unnest(range(len(skill_list))) AS place FROM kept",
            "companies": "SELECT company AS name, ord, 0 AS place FROM kept",
            "locations": "SELECT location_raw AS name, ord, 0 AS place FROM kept",
        }.items()
    ))

ORACLE: dict[str, str] = {
    "norm_text_fields": _jobs(
        "SELECT pos, language, normalized_title, location_city, location_country, description_snippet FROM dated"
    ),
    "norm_classify": _jobs("SELECT pos, remote_type, employment_type, seniority_level FROM dated"),
    "norm_skills": _jobs(f"SELECT pos, {_SKILLS} AS skills FROM dated"),
    "norm_ids": _jobs("SELECT pos, id, source, source_job_id, source_job_url FROM dated"),
    "norm_hosts": _HOSTS,
    "norm_time": _jobs(f"SELECT pos, {_stamp('posted_at')} AS posted_at, freshness_days FROM dated"),
    "document_text": f"""WITH cleaned AS (SELECT doc_id, {_clean('text')} AS t FROM documents)
SELECT doc_id, md5(t) AS cleaned_md5,
  CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 277)) || '...' END AS snippet,
  CASE WHEN regexp_matches(coalesce(t, ''), '[{lexicon.TURKISH_LETTERS}]') THEN 'tr' ELSE 'en' END AS language
FROM cleaned""",
    "page_urls": f"SELECT page_id, {_canonical('url')} AS canonical, url AS valid FROM pages",
    "dedupe_payload": f"""WITH {LISTINGS}
SELECT pos, source, order_key % 50 AS payload_id FROM raw QUALIFY row_number() OVER (PARTITION BY src_rank, order_key % 50,
  coalesce(source_job_id, source_job_url, company || '::' || title) ORDER BY pos) = 1""",
    "dedupe_url": f"""WITH {LISTINGS}
SELECT pos, source, source_job_url FROM (SELECT *, {_canonical('source_job_url')} AS c FROM raw)
QUALIFY c IS NULL OR row_number() OVER (PARTITION BY c ORDER BY {_ARRIVAL}) = 1""",
    "dedupe_pages": f"""SELECT page_id, url AS source_job_url FROM pages
QUALIFY row_number() OVER (PARTITION BY {_canonical('url')} ORDER BY page_id) = 1""",
    "search_filtered": _search(
        f"contains({_QUERY_TEXT}, 'python') AND employment_type = 'full_time' AND seniority_level = 'senior' "
        "AND remote_type IN ('remote', 'hybrid')", 0
    ),
    "search_country_tr": _search(f"({_TURKEY}) AND seniority_level = 'lead'", 50),
    "search_location": _search(f"contains({_WHERE_TEXT}, 'europe') AND remote_type = 'onsite'", 0),
    "search_page10000": _search("TRUE", 49_995, 5),
    "search_deep_filtered": _search(f"contains({_QUERY_TEXT}, 'engineer') AND remote_type IN ('remote', 'hybrid')", 899 * 7, 7),
    "search_page3": _search("TRUE", 100),
    "search_meta": _jobs(
        'SELECT 2 AS page, 7 AS "limit", CAST(greatest(ceil(count(*) / 7.0), 1) AS BIGINT) AS total_pages, '
        f"count(*) AS total_results FROM dated WHERE contains({_QUERY_TEXT}, 'java') AND contains({_WHERE_TEXT}, 'a')"
    ),
    "recent_jobs": _jobs(f"SELECT {_HIT} FROM dated ORDER BY {_STORED_ORDER} LIMIT 100"),
    "top_skills": _top(
        "SELECT unnest(skills) AS name, ord, unnest(range(len(skills))) AS place FROM placed", 20
    ),
    "top_companies": _top("SELECT nullif(company, '') AS name, ord, 0 AS place FROM placed", 10),
    "top_locations": _top("SELECT location_raw AS name, ord, 0 AS place FROM placed", 10),
    "insight_count": _jobs(
        "SELECT 'skills' AS dimension, least(count(DISTINCT s), 50) AS \"count\" FROM (SELECT unnest(skills) AS s FROM dated)"
    ),
    "lookup_by_ids": _jobs(
        f"SELECT {_HIT} FROM dated WHERE id IN (SELECT min(id) FROM dated GROUP BY company)"
    ),
    "upsert_two_batches": _UPSERT,
    "schema_backfill": _jobs(
        "SELECT pos, language, " + ", ".join(
            f"CASE WHEN src_rank = 0 THEN '2026-03-23 11:30:00' ELSE '2026-03-22 09:00:00' END AS {name}"
            for name in ("created_at", "updated_at", "last_seen_at")
        ) + " FROM dated"
    ),
    "export_roundtrip": _jobs(f"SELECT id, {_SKILLS} AS skills, {_stamp('posted_at')} AS posted_at FROM dated"),
    "upsert_repointed": _REPLAY,
    "stored_lookup": _jobs(f"""{_MERGED}, wanted AS (SELECT id, source_job_url FROM dated WHERE order_key % 64 = 3)
SELECT id, source_job_url, 'id' AS way FROM kept WHERE id IN (SELECT id FROM wanted)
UNION ALL SELECT id, source_job_url, 'url' FROM kept WHERE source_job_url IN (SELECT source_job_url FROM wanted)"""),
    "list_jobs": _jobs(f"{_MERGED} SELECT id, title, company, freshness_days FROM kept"),
    "stored_search": _jobs(f"""{_MERGED},
newest AS (SELECT * REPLACE (first_value(id) OVER (PARTITION BY ident ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS id),
    min(arrival) OVER (PARTITION BY ident) AS born FROM arrived QUALIFY row_number() OVER (PARTITION BY ident ORDER BY arrival DESC) = 1)
SELECT {_HIT} FROM newest WHERE contains({_QUERY_TEXT}, 'kubernetes') AND contains({_WHERE_TEXT}, 'asia')
ORDER BY freshness_days ASC NULLS LAST, lower(coalesce(title, '')), born LIMIT 50 OFFSET 50"""),
    "kept_insights": _STORED_INSIGHTS,
    "stored_insights": _STORED_INSIGHTS,
    "insert_branch": _jobs(
        "SELECT pos, id FROM dated WHERE order_key % 2 = 1 AND id NOT IN (SELECT id FROM dated WHERE order_key % 2 = 0) AND "
        "NOT EXISTS (FROM jobs o WHERE o.order_key % 2 = 0 AND o.source_job_url = dated.source_job_url)"
    ),
    "json_ingest": _JSON,
    "ingest_search": f"""{_INGESTED} SELECT {_HIT} FROM dated WHERE contains({_QUERY_TEXT}, 'engineer')
AND remote_type IN ('remote', 'hybrid') ORDER BY {_SEARCH_ORDER} LIMIT 40 OFFSET 40""",
    "landing_quarantine": _LANDED,
    "landing_stream": f"""SELECT CASE src_rank WHEN {len(lexicon.SOURCES)} THEN 'public-source' ELSE 'remotive' END AS source,
  source_job_id, title, '2026-03-22 09:00:00' AS created_at FROM ({_LANDED}) WHERE reject_reason IS NULL""",
    "single_source": f"""SELECT 'remotive' AS source, source_job_id, title FROM ({_LANDED})
WHERE reject_reason IS NULL AND src_rank < {len(lexicon.SOURCES)}""",
    "bounds_report": """SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 5 = 0 THEN 'skills_empty'
  WHEN c_custkey % 7 = 0 OR c_custkey % 12 = 0 THEN 'experience_years_invalid' END AS reject_reason FROM customer""",
    "top_places": _top(
        "SELECT coalesce(CASE WHEN order_key % 2 = 0 THEN location_raw END, "
        "nullif(concat_ws(', ', location_city, location_country), '')) AS name, ord, 0 AS place FROM placed", 30
    ),
    "feed_places": f"WITH {LISTINGS} SELECT pos, location_raw || ', ' || company AS places FROM raw",
    "html_cards_ingest": _CARDS,
    "html_rows_ingest": _ROWS,
    "payload_quarantine": _QUARANTINE,
    "event_props_json": (
        "SELECT event_id, json_extract_string(props, '$.k') AS k, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events"
    ),
    "html_text": f"SELECT page_id, {_PAGE_TEXT} AS text FROM pages",
    "html_links": f"SELECT page_id, {_PAGE_LINK} AS link FROM pages",
    "ranked_list_resolve": _RANKED,
    "response_matches": _RANKED.replace('SELECT list_id, CAST', 'SELECT list_id AS response_id, CAST').replace(
        "WHERE r < 5", "WHERE r < 5 AND list_id % 5 > 0"
    ),
    "candidate_match": _MATCH,
    "match_all_jobs": _MATCH_ALL,
    "match_records": _MATCH_RECORDS,
    "skills_gap": _jobs(_GAP + " SELECT request_id, skill, jobs FROM gap"),
    "missing_skills": _jobs(
        _GAP + " SELECT request_id, string_agg(skill, ',' ORDER BY jobs DESC, skill) AS missing_skills FROM gap GROUP BY request_id"
    ),
    "prompt_table": _PROMPTS,
    "gap_prompts": _GAP_PROMPTS,
    "response_clean": _RESPONSES,
    "event_rate_cap": _RATE_CAP,
}
