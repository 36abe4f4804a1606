import random
import re
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblode.operators import insights, match, overlap, search
from joblode.operators.normalize import Wanted, normalize_listings
from joblode.schemas import JOB, ORDER_COLUMNS, STORED_ORDER_COLUMNS
from joblode.sources import derived
from joblode.sources.ranges import SortedJobs
from joblode.sources.store import JobTable

T1 = datetime(2026, 3, 22, 9, 0, tzinfo=timezone.utc)
T2 = datetime(2026, 3, 23, 11, 30, tzinfo=timezone.utc)
SCHEMA = T.StructType([*JOB.fields, T.StructField("src_rank", T.IntegerType()), T.StructField("payload_id", T.StringType()), T.StructField("pos", T.LongType())])
WORDS = ["Data", "java", "C++", "a", "İzmir", "ops", "data%", "eng_", "Şef", "日本"]
PLACES = ["Berlin, Germany", "Izmir, Türkiye", "Remote", "", None]


def made(spark, rng, count, first=0):
    rows = []
    for i in range(first, first + count):
        text = lambda: " ".join(rng.choices(WORDS, k=rng.randint(0, 4))) if rng.random() < 0.9 else None
        rows.append({
            "id": f"j{i}", "source_job_url": f"u{i}" if i % 5 else None, "source": "s", "title": text(), "normalized_title": text(), "company": text(),
            "location_raw": rng.choice(PLACES), "location_city": rng.choice(["Ankara", None]), "remote_type": rng.choice(["remote", "onsite", "hybrid", None]),
            "description_snippet": text(), "skills": rng.sample(["python", "sql", "go", "data"], rng.randint(0, 3)) if rng.random() < 0.9 else None,
            "freshness_days": rng.choice([0, 1, 2, None]), "src_rank": 0, "payload_id": "p", "pos": i,
        })
    return spark.createDataFrame([tuple(r.get(n) for n in SCHEMA.names) for r in rows], SCHEMA)


def ids(rows):
    return [r.id for r in rows.collect()]


SPECS = [
    {"q": "data"}, {"q": "DATA JAVA"}, {"q": "c++"}, {"q": "data%"}, {"q": "a"}, {"q": "ta"}, {"q": "a  d"}, {"q": "ops java data eng_ şef"}, {"q": "日本"},
    {"q": "nothing here"}, {"location": "izmir"}, {"location": "berlin, germany ankara"}, {"country": " Germany "}, {"country": "tr"}, {"q": "java", "location": "ankara", "remote": True}, {},
]


def test_search_through_postings_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    table = JobTable(spark, str(tmp_path), buckets=4, keep=(derived.GRAMS,))
    assert table.search(search.SearchSpec(q="data")).count() == 0
    table.upsert(made(spark, rng, 120), T1)
    table.upsert(made(spark, rng, 60, first=100), T2)  # twenty known ids with other texts
    assert set(table._latest().derived) == {derived.GRAMS}
    for spec in SPECS:
        spec = search.SearchSpec(**spec, limit=50)
        assert ids(table.search(spec)) == ids(search.search_page(table.read(), spec, STORED_ORDER_COLUMNS)), spec


def test_a_rare_needle_opens_few_buckets(spark, tmp_path):
    rng = random.Random(6)
    rows = made(spark, rng, 400)
    rows = rows.withColumn("company", F.when(F.col("id").isin("j7", "j8"), "Quixotic").otherwise(F.col("company")))
    table = JobTable(spark, str(tmp_path), buckets=16, keep=(derived.GRAMS,))
    table.upsert(rows, T1)
    spec = search.SearchSpec(q="uixot")
    held = table._derived(table._latest(), derived.GRAMS)
    met = derived.meeting(held, derived.probes(spec))
    assert sorted(ids(met)) == ["j7", "j8"]
    assert "In(gram, [" in met._jdf.queryExecution().executedPlan().toString()
    opened = {f.rsplit("/", 2)[1] for f in table.by_ids(table.staged(met)).inputFiles()}
    assert len(opened) <= 2 and sorted(ids(table.search(spec))) == ["j7", "j8"]


def test_kept_kinds_follow_the_merges(spark, tmp_path):
    rng = random.Random(8)
    table = JobTable(spark, str(tmp_path), buckets=8)
    table.upsert(made(spark, rng, 80), T1)
    assert not table._latest().derived
    table = JobTable(spark, str(tmp_path), buckets=8, keep=(derived.NAMES, derived.GRAMS))  # begun later: made for all buckets
    table.upsert(made(spark, rng, 3, first=79), T2)
    before = table._latest().derived
    plain = JobTable(spark, str(tmp_path), buckets=8)  # goes on keeping what is kept
    plain.upsert(made(spark, rng, 1, first=5), T2)
    plain.upsert(made(spark, rng, 40, first=60), T2)
    after = plain._latest().derived
    assert set(before) == set(after) == {derived.NAMES, derived.GRAMS}
    rows = plain.read()
    want = {"skills": insights.top_skills, "companies": insights.top_companies, "locations": insights.top_locations}
    for dimension, function in want.items():
        got = [tuple(r) for r in plain.top(dimension, 50).collect()]
        assert got == [tuple(r) for r in function(rows, 50).collect()] and got
    spec = search.SearchSpec(q="data", limit=50)
    assert ids(plain.search(spec)) == ids(search.search_page(rows, spec, STORED_ORDER_COLUMNS))
    plain.vacuum(keep=1)
    assert ids(plain.search(spec)) == ids(search.search_page(rows, spec, STORED_ORDER_COLUMNS))
    assert plain.top("skills", 5).count() > 0
    live = {f.split("/")[0] for kind in after.values() for f in kind.values()}
    assert live == {derived.NAMES, derived.GRAMS}


def test_a_merge_rewrites_derived_rows_of_touched_buckets_only(spark, tmp_path):
    rng = random.Random(9)
    table = JobTable(spark, str(tmp_path), buckets=8, keep=(derived.NAMES, derived.GRAMS))
    table.upsert(made(spark, rng, 100), T1)
    before = table._latest()
    table.upsert(made(spark, rng, 1, first=6), T2)
    after = table._latest()
    touched = {b for b in before.folders if before.folders[b] != after.folders[b]}
    assert len(touched) == 1
    for kind in before.derived:
        assert {b for b in before.derived[kind] if before.derived[kind][b] != after.derived[kind].get(b)} <= touched
    empty = JobTable(spark, str(tmp_path / "empty"), keep=(derived.NAMES, derived.GRAMS))
    empty.commit(table.read().limit(0), T1)
    assert empty.top("skills", 5).count() == empty.search(search.SearchSpec(q="data")).count() == 0


def test_pages_open_their_range(spark, tmp_path):
    rng = random.Random(12)
    jobs = made(spark, rng, 300)
    ranges = SortedJobs(spark, str(tmp_path)).build(jobs, range_rows=40)
    total = {row["range"]: row.n for row in ranges._index(search.SearchSpec()).collect()}
    assert sum(total.values()) == 300 and len(total) >= 5
    for given in SPECS[:1] + SPECS[9:10] + SPECS[13:]:
        for page, limit in [(1, 7), (3, 20), (30, 10), (31, 10), (2, 50), (100_000, 1)]:
            spec = search.SearchSpec(**given, page=page, limit=limit)
            assert ids(ranges.page(spec)) == ids(search.search_page(jobs, spec)), spec
    opened = {f.rsplit("/", 2)[1] for f in ranges.page(search.SearchSpec(page=120, limit=2)).inputFiles()}
    assert len(opened) <= 2
    nothing = SortedJobs(spark, str(tmp_path / "none")).build(jobs.limit(0))
    assert nothing.page(search.SearchSpec()).count() == nothing.page(search.SearchSpec(q="data")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_out_of_all_jobs_equal_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["python"] * 6 + ["sql"] * 3 + ["go", "rust", "r", "java"]
    rows, people = [], []
    for i in range(300):
        skills = list({rng.choice(names) for _ in range(rng.randint(0, 5))})
        skills = None if i % 50 == 0 else skills + [None] * (i % 41 == 0)
        rows.append((f"j{i % 290}", rng.choice(["A", "B", None]), rng.choice(PLACES), rng.choice(["remote", "onsite", None]), skills, rng.choice([0, 1, None]), 0, "p", i))
    for i in range(150):
        own = [rng.choice([" Python", "sql", "GO", "rust", "r", "java", "cobol"]) for _ in range(rng.randint(0, 5))]
        people.append((i, own, rng.randint(-1, 5), rng.choice(["berlin", "izmir", "e", "", " ", None]), rng.choice([True, False, None])))
    jobs = spark.createDataFrame(rows, "id string, title string, location_raw string, remote_type string, skills array<string>, freshness_days int, src_rank int, payload_id string, pos long")
    candidates = spark.createDataFrame(people, "candidate_id long, skills array<string>, experience_years int, preferred_location string, remote_preferred boolean")
    for limit in (1, 5, 400):
        got = overlap.match_all(candidates, jobs, limit, ORDER_COLUMNS)
        want = match.match_candidates(candidates, jobs, 1000, limit, ORDER_COLUMNS)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlap.match_all(candidates.limit(0), jobs, 5, ORDER_COLUMNS).count() == overlap.match_all(candidates, jobs.limit(0), 5, ORDER_COLUMNS).count() == 0


def test_common_skills_are_left_out_once_enough_jobs_share_more(spark):
    sets = [(["python"], 10**6), (["python", "sql"], 10**5), (["go", "python", "sql"], 9), (["go"], 3)]
    wanted = spark.createDataFrame([(["go", "python", "sql"],), (["python"],)], "own array<string>")
    got = overlap.overlapping(wanted, spark.createDataFrame(sets, "has array<string>, n long"), 5).collect()
    assert sorted((r.own, r.has, r.shared) for r in got) == [
        (["go", "python", "sql"], ["go", "python", "sql"], 3), (["python"], ["go", "python", "sql"], 1), (["python"], ["python"], 1), (["python"], ["python", "sql"], 1),
    ]


def test_pages_out_of_listings_finish_only_the_page(spark, listings):
    rng = random.Random(8)
    rows = [{
        "title": rng.choice(["Senior Python Dev", "Data Engineer", "dev", None]), "company": rng.choice(["Acme", None]), "location_raw": rng.choice(PLACES),
        "remote_type_raw": rng.choice(["remote", "onsite", None]), "posted_at_raw": rng.choice(["2026-03-20", "1774000000", "99999999999999999", None]),
        "tags": rng.sample(["Python", "SQL", "K8s"], rng.randint(0, 2)), "src_rank": rng.choice([None, 0, 1]), "payload_id": f"p{i % 3}",
    } for i in range(120)]
    raw = listings(*rows)
    day = T1.date()
    jobs = normalize_listings(raw, day)
    for spec in ({}, {"q": "python", "remote": True}, {"country": "tr", "page": 2}, {"seniority": "senior", "limit": 50}, {"page": 12}, {"page": 99}):
        spec = search.SearchSpec(**spec)
        assert search.search_listings(raw, day, spec).collect() == search.search_page(jobs, spec).collect()
    assert search.recent_of_listings(raw, day, 30).collect() == search.recent_jobs(jobs, 30, ORDER_COLUMNS).collect()
    assert search.search_listings(raw.limit(0), day, search.SearchSpec()).collect() == []
    with pytest.raises(ValueError):
        search.recent_of_listings(raw, day, 10_001)
    plan = search.search_listings(raw, day, search.SearchSpec())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_listings_that_cannot_pass_are_not_finished(spark, listings):
    """Early tests leave out no hit: skills behind aliases and tags, letters whose case changes, bracketed words."""
    day = date(2026, 3, 22)
    titles = ["Senior Java dev", "QA (Remote, Full-time)", "Yazılım TR", "jr. K8s admin", "ja(remote)va", "Straße GROSS", "Sr engineer", "Ja|va lead", "", None]
    places = ["Istanbul, Turkey", "Remote", None, "Berlin, Germany", "İzmir", "on site"]
    notes = ["Node.js and TS", "full  time permanent", None, "work from home, TypeScript", "golang or postgres"]
    tags = [[], ["JS"], None, ["k8s", " Java "], ["remote", "Golang"]]
    rows = [
        {"title": titles[i % 10], "location_raw": places[i % 6], "description_text": notes[i % 5], "tags": tags[(i // 2) % 5],
         "employment_type_raw": [None, "Full-time", "fixed term"][i % 3], "remote_type_raw": [None, "Remote-first", "onsite", "anywhere"][i % 4],
         "company": ["Javelin", None, "Ss AG"][i % 3], "source": "remotive", "posted_at_raw": "2026-03-01"} for i in range(240)
    ]
    raw = listings(*rows)
    jobs = normalize_listings(raw, day).cache()
    asked = [
        {"q": q} for q in ("java", "JavaScript", "kubernetes", "go", "post", "ss", "strasse", "ı", "engineer", "a b", "typescript", "remote")
    ] + [{"remote": False}, {"remote": True, "employment_type": "full_time"}, {"employment_type": "other"}, {"seniority": "unknown"},
         {"seniority": "junior", "q": "kubernetes"}, {"country": "TR"}, {"country": "germany", "location": "berlin"}, {"location": "zmir", "q": "java"}]
    for spec in (search.SearchSpec(**values) for values in asked):
        early = normalize_listings(raw, day, wanted=search.wanted(spec))
        held = {row.pos for row in search.filter_jobs(early, spec).select("pos").collect()}
        assert held == {row.pos for row in search.filter_jobs(jobs, spec).select("pos").collect()}, spec
        assert search.search_meta(early, spec).collect() == search.search_meta(jobs, spec).collect()
    few = normalize_listings(raw, day, wanted=Wanted(labels={"seniority_level": ["junior"]}))
    assert 0 < few.count() < raw.count() / 4
    assert normalize_listings(raw, day, wanted=Wanted(text="kubernetes")).count() < raw.count()
    assert normalize_listings(raw, day, wanted=search.wanted(search.SearchSpec(country="tr"))).count() < raw.count()
    plan = search.search_listings(raw, day, search.SearchSpec(seniority="junior"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_evidence" in plan and "Contains(_evidence" in plan


def test_jobs_in_a_common_place_are_few_before_they_meet_wishes(spark):
    """Jobs of a place are cut to the first few of each skill set before the join by place."""
    rows = [(f"j{i}", "A", "Remote" if i % 10 else "Berlin", "remote", ["python"] if i % 3 else ["sql"], i % 4, 0, "p", i) for i in range(2000)]
    people = [(1, ["python"], 2, "remote", True), (2, ["sql", "python"], 2, "berlin", False), (3, ["sql"], 1, "e", None)]
    jobs = spark.createDataFrame(rows, "id string, title string, location_raw string, remote_type string, skills array<string>, freshness_days int, src_rank int, payload_id string, pos long")
    candidates = spark.createDataFrame(people, "candidate_id long, skills array<string>, experience_years int, preferred_location string, remote_preferred boolean")
    got = overlap.match_all(candidates, jobs, 5, ORDER_COLUMNS)
    want = match.match_candidates(candidates, jobs, 2000, 5, ORDER_COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"WindowGroupLimit \[has#\d+, _remote#\d+, _where#\d+\]", plan)


def test_ranges_outnumber_the_tasks_that_sort_them(spark, tmp_path):
    jobs = made(spark, random.Random(5), 300)
    ranges = SortedJobs(spark, str(tmp_path)).build(jobs, range_rows=5)
    sizes = [row.n for row in ranges._index(search.SearchSpec()).collect()]
    tasks = {file.name.split("-")[1] for file in tmp_path.glob("rows/range=*/part-*")}
    assert sum(sizes) == 300 and max(sizes) <= 5 and len(tasks) <= 4 * spark.sparkContext.defaultParallelism < len(sizes)
    for page, limit in [(1, 7), (3, 20), (30, 10), (60, 5)]:
        spec = search.SearchSpec(page=page, limit=limit)
        assert ids(ranges.page(spec)) == ids(search.search_page(jobs, spec)), spec
