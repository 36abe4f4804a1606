import json
import random
import re
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from joblode.operators import containing, match, ratecap, responses
from joblode.schemas import CANDIDATES

JOBS = (
    "id string, title string, normalized_title string, company string, location_raw string, remote_type string, "
    "employment_type string, seniority_level string, skills array<string>, language string, freshness_days int, pos int"
)


@pytest.fixture
def jobs(spark):
    rows = [
        ("j1", "Python Dev", "Python Dev", "A", "Istanbul", "remote", None, None, ["python", "sql"], "en", 0, 0),
        ("j2", "Data Dev", "Python Dev", "B", "Berlin", "onsite", None, None, ["python", "docker"], "en", 1, 1),
        ("j3", "Ops", "Ops", "C", "Berlin", None, None, None, ["go"], "en", 2, 2),
        ("j4", "Old", "Old", "D", None, "hybrid", None, None, ["python", "sql"], "en", 9, 3),
    ]
    return spark.createDataFrame(rows, JOBS)


def test_ranked_lists(spark, jobs):
    lists = spark.createDataFrame(
        [("a", ["j1", "j2", "j2", "missing"]), ("b", ["x"]), ("c", ["j4", "j3", "j2", "j1", "j4"]), ("d", [])],
        "list_id string, job_ids array<string>",
    )
    rows = match.resolve_ranked_lists(lists, jobs, order_columns=["pos"]).orderBy("list_id", "rank").collect()
    assert [(r.list_id, r.job.id, r.match_score) for r in rows] == [
        ("a", "j1", 100), ("a", "j2", 90), ("c", "j4", 100), ("c", "j3", 90), ("c", "j2", 80), ("c", "j1", 70),
    ]
    short = match.resolve_ranked_lists(lists, jobs, 1, ["pos"]).collect()
    assert sorted((r.list_id, r.job.id) for r in short) == [("a", "j1"), ("c", "j4")]


def test_an_id_stands_for_its_last_record(spark, jobs):
    twice = jobs.unionByName(jobs.withColumn("title", F.concat(F.lit("again "), "title")).withColumn("pos", F.col("pos") + 10))
    lists = spark.createDataFrame([("c", ["j4", "j3", "j2", "j1", "j4"])], "list_id string, job_ids array<string>")
    rows = match.resolve_ranked_lists(lists, twice, order_columns=["pos"]).orderBy("rank").collect()
    assert [(r.rank, r.job.title) for r in rows] == [(0, "again Old"), (1, "again Ops"), (2, "again Data Dev"), (3, "again Python Dev")]
    for pool, limit in [(0, 5), (10**6, 5), (5, 0)]:
        with pytest.raises(ValueError):
            match.check_bounds(pool, limit)


def test_scores_stop_at_ten(spark):
    rows = spark.range(12).select(F.col("id"), match.match_score(F.col("id")).alias("s")).orderBy("id").collect()
    assert [r.s for r in rows] == [100, 90, 80, 70, 60, 50, 40, 30, 20, 10, 10, 10]


def test_match_candidates(spark, jobs):
    people = spark.createDataFrame([
        (1, ["Python", "sql", "python"], 3, " istanbul ", True), (2, ["docker"], 0, None, None),
        (3, ["cobol"], 1, None, None), (4, [], 1, None, None), (5, ["go"], -1, None, None),
    ], CANDIDATES)
    got = match.match_candidates(people, jobs, order_columns=["pos"])
    rows = got.orderBy("candidate_id", "rank").collect()
    assert [(r.candidate_id, r.job_id, r.shared_skills, r.match_score) for r in rows] == [
        (1, "j1", 2, 100), (1, "j4", 2, 90), (1, "j2", 1, 80), (2, "j2", 1, 100),
    ]
    limited = match.match_candidates(people, jobs, pool=1, order_columns=["pos"]).collect()
    assert {r.job_id for r in limited} == {"j1"}
    records = match.match_records(people, jobs, order_columns=["pos"]).filter("job.id = 'j4'").collect()
    assert [(r.match_score, r.job.company) for r in records] == [(90, "D")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    bad = match.check_candidates(people).filter("reject_reason IS NOT NULL").collect()
    assert {r.candidate_id: r.reject_reason for r in bad} == {4: "skills_empty", 5: "experience_years_invalid"}


def test_containing_equals_the_nested_loop(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c\u0131", k=rng.randint(0, 12))) for _ in range(200)] + ["", "aa", "aa", None, "x" * 3000 + "y"]
    needles = ["".join(rng.choices("ab c\u0131", k=rng.randint(0, 6))) for _ in range(150)] + ["", None, "xy", "a", "zzz", "a" * 40, "a", "x" * 2000]
    got = containing.containing(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(t,) for t in texts], "text string")
    )
    want = {(n, t) for n in needles for t in texts if n and t is not None and n in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = containing.containing(spark.createDataFrame([], "needle string"), spark.createDataFrame([], "text string"))
    assert none.collect() == []


def test_skills_gap_looks_inside_titles(spark, jobs):
    more = jobs.unionByName(jobs.filter("id = 'j1'").withColumns({"id": F.lit("j5"), "normalized_title": F.lit("Lead Python Developer"), "skills": F.array(F.lit("rust"))}))
    asked = [(1, ["sql"], "python dev"), (2, ["go"], "Dev"), (3, ["go"], "Nothing"), (4, ["go"], " "), (5, [], "dev"), (6, ["go"], None)]
    requests = spark.createDataFrame(asked, "request_id int, current_skills array<string>, target_job_title string")
    gap = sorted((r.request_id, r.skill, r.jobs) for r in match.skills_gap(requests, more).collect())
    both = [("docker", 1), ("python", 2), ("rust", 1)]
    assert gap == [(1, *x) for x in both] + [(2, *x) for x in both] + [(2, "sql", 1)]


def test_skills_gap(spark, jobs):
    requests = spark.createDataFrame(
        [(1, ["SQL"], "Senior python dev"), (2, ["python"], "Astronaut"), (3, [], "Ops"), (4, ["x"], " ")],
        "request_id int, current_skills array<string>, target_job_title string",
    )
    gap = match.skills_gap(requests, jobs)
    assert sorted((r.request_id, r.skill, r.jobs) for r in gap.collect()) == [(1, "docker", 1), (1, "python", 2)]
    assert [(r.request_id, r.missing_skills) for r in match.missing_skills(requests, jobs).collect()] == [(1, ["python", "docker"])]


def test_prompts(spark, jobs):
    people = spark.createDataFrame([(1, ["a\"b"], 2, None, True)], CANDIDATES)
    prompt = responses.match_prompts(people, jobs, pool=2, order_columns=["pos"]).first().prompt
    listed = json.loads(prompt.split("Open jobs: ")[1].split("\n")[0])
    assert [job["id"] for job in listed] == ["j1", "j2"]
    assert list(listed[0]) == match.MATCH_FIELDS and listed[0]["employment_type"] is None
    assert '["a\\"b"]' in prompt and "Preferred location: not given" in prompt and "work: true" in prompt
    requests = spark.createDataFrame([(1, ["x"], "Chef")], "request_id int, current_skills array<string>, target_job_title string")
    assert "Target job title: Chef" in responses.gap_prompts(requests).first().prompt


GAP = {"missing_skills": ["k8s"], "learning_priority": "high", "estimated_learning_time": "3 months"}
RESPONSES = [
    ("m1", "match", '["j1", " j2 ", "", 5, null]', None),
    ("m2", "match", '```json\n["j1"]\n```', None),
    ("m3", "match", "not json", "invalid_json"),
    ("m4", "match", "{}", "unexpected_shape"),
    ("m5", "match", "  ", "empty_response"),
    ("m6", "match", None, "empty_response"),
    ("m7", "match", "[1] [2]", "invalid_json"),
    ("g1", "gap", json.dumps(GAP), None),
    ("g2", "gap", "```\n" + json.dumps(GAP | {"recommended_resources": ["r"]}) + "```", None),
    ("g3", "gap", json.dumps(GAP | {"learning_priority": 3}), "invalid_analysis"),
    ("g4", "gap", json.dumps(GAP | {"missing_skills": None}), "invalid_analysis"),
    ("g5", "gap", json.dumps(GAP | {"missing_skills": ["a", 1]}), "invalid_analysis"),
    ("g6", "gap", json.dumps({k: v for k, v in GAP.items() if k != "missing_skills"}), None),
    ("g7", "gap", "[]", "unexpected_shape"),
]


def test_response_cleaning(spark, jobs):
    table = spark.createDataFrame([row[:3] for row in RESPONSES], "response_id string, kind string, text string")
    rows = {r.response_id: r for r in responses.clean_responses(table).collect()}
    assert {i: r.error_code for i, r in rows.items()} == {row[0]: row[3] for row in RESPONSES}
    assert (rows["m1"].job_ids, rows["m2"].job_ids) == (["j1", "j2"], ["j1"])
    assert rows["g2"].analysis.asDict() == {**GAP, "recommended_resources": ["r"]}
    assert (rows["g6"].analysis.missing_skills, rows["g1"].analysis.recommended_resources) == ([], [])
    matched = responses.matches_from_responses(table, jobs, ["pos"]).orderBy("response_id", "rank").collect()
    assert [(r.response_id, r.job.id, r.match_score) for r in matched] == [("m1", "j1", 100), ("m1", "j2", 90), ("m2", "j1", 100)]


def plain_cap(times, limit, window):
    log, flags = [], []
    for now in times:
        log = [t for t in log if t > now - window]
        flags.append(len(log) < limit)
        if flags[-1]:
            log.append(now)
    return flags


def test_admit_equals_a_plain_log():
    rng = np.random.default_rng(1)
    for limit in (1, 2, 5):
        times = np.sort(rng.integers(0, 400, 300))
        recent, flags = deque(), []
        for part in np.array_split(times, 7):
            flags += list(ratecap.admit(part, recent, limit, 40))
        assert flags == plain_cap(list(times), limit, 40)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_rate_cap(spark, partitions):
    rng = np.random.default_rng(2)
    start = datetime(2026, 1, 1)
    rows = [(int(k), start + timedelta(seconds=int(s)), i) for i, (k, s) in enumerate(
        zip(rng.choice([1, 1, 1, 2, 3], 800), rng.choice([*range(0, 3000), *range(9000, 9300)], 800)))]
    rows += [(9, start, 1000), (9, start, 1001), (9, start, 1002), (9, start + timedelta(seconds=60), 1003)]
    events = spark.createDataFrame(rows, "k int, ts timestamp, e int").repartition(partitions)
    got = {r.e: r.accepted for r in ratecap.rate_cap(events, "k", "ts", "e", 2, 60).collect()}
    expected = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        flags = plain_cap([(t - start).total_seconds() for t, _ in mine], 2, 60)
        expected |= {e: f for (_, e), f in zip(mine, flags)}
    assert got == expected
    assert [got[e] for e in (1000, 1001, 1002, 1003)] == [True, True, False, True]


@pytest.mark.parametrize("regular", [True, False])
def test_busy_key_spans_chunks(spark, regular):
    """Without a pause; at regular times the speculative scans never fall in step."""
    start = datetime(2026, 1, 1)
    draw = np.random.default_rng(4)
    seconds = np.arange(3000) if regular else np.sort(draw.integers(0, 40_000, 3000))
    rows = [("hot", start + timedelta(seconds=int(s)), i) for i, s in enumerate(seconds)]
    rows += [(None, start + timedelta(seconds=int(s)), 10_000 + i) for i, s in enumerate(draw.integers(0, 4000, 900))]
    rows += [("same", start, 20_000 + i) for i in range(700)] + [("late", None, 30_000)]
    events = spark.createDataFrame(rows, "k string, ts timestamp, e int").repartition(5)
    got = {r.e: r.accepted for r in ratecap.rate_cap(events, "k", "ts", "e", 3, 60, chunk_events=400).collect()}
    expected = {30_000: False}
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key and r[1])
        expected |= dict(zip([e for _, e in mine], plain_cap([(t - start).total_seconds() for t, _ in mine], 3, 60), strict=True))
    assert got == expected


def test_cap_of_an_empty_table(spark):
    assert ratecap.rate_cap(spark.createDataFrame([], "k int, ts timestamp, e int"), "k", "ts", "e", 2, 60).collect() == []


def test_an_id_of_many_lists_meets_its_record_in_parts(spark, jobs, monkeypatch):
    listed = [["x", "j1", "x"], ["j1", None, "j2"], ["nobody", "j2", "j1", "j2"]] * 20
    lists = spark.createDataFrame([*enumerate(listed), (0, ["j4"])], "list_id int, job_ids array<string>")

    def found():
        got = match.resolve_ranked_lists(lists, jobs, order_columns=["pos"])
        return got, sorted((r.list_id, r["rank"], r.match_score, r.job.id) for r in got.collect())

    plain = found()[1]
    monkeypatch.setattr(match, "MEETING_ROWS", 7)
    got, dealt = found()
    assert dealt == plain and [row for row in plain if row[0] in (1, 2)] == [(1, 0, 100, "j1"), (1, 1, 90, "j2"), (2, 0, 100, "j2"), (2, 1, 90, "j1")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "((id = id) AND (_part = _part))" in re.sub(r"#\d+", "", plan)


def test_a_response_is_read_once(spark):
    texts = spark.createDataFrame([(1, "match", '["a"]')], "response_id int, kind string, text string")
    plan = responses.clean_responses(texts).filter("error_code IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") <= 2 * plan.count("_listed")  # both forms, each made in one place
    assert "parse" not in "".join(line.lower() for line in plan.splitlines() if "Filter" in line)
