"""The best jobs for each candidate out of all jobs, without a pool.

Jobs and candidates are reduced to what decides a match before they meet. Of jobs with the same skills and the same
remote flag only the first few in stored order can win, for each wished-for place once more among the jobs that lie
there; candidates with equal wishes are one profile. Skill sets meet skill sets by their rarest skill. That gives each
wanted set a number of shared skills that enough jobs reach; a set that shares as many must hold one of the rarest
skills up to this bound, so only these are looked up then, and the skills that most jobs ask for are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblode import lexicon
from joblode.functions.text import blank_to_null
from joblode.operators.containing import containing
from joblode.operators.match import check_candidates, top_scored
from joblode.operators.search import check_between, stored_order
from joblode.schemas import STORED_ORDER_COLUMNS


def _skill_set(skills: Column) -> Column:
    return F.array_sort(F.array_compact(F.array_distinct(skills)))


def overlapping(wanted: DataFrame, sets: DataFrame, enough: int) -> DataFrame:
    """(own, has, shared): the skill sets that can be among the best for a wanted one.

    wanted: own, distinct sorted sets. sets: has, distinct sorted sets, and n, the number of jobs behind each. For each
    wanted set all pairs come whose number of shared skills is at least that which the best `enough` jobs reach.
    """
    held = sets.select(F.explode("has").alias("skill"), "has", "n")
    spread = held.groupBy("skill").agg(F.sum("n").alias("jobs"))
    asked = wanted.select("own", F.explode("own").alias("skill")).join(spread, "skill")
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("jobs", "skill"))), lambda x: x.skill)
    plan = asked.groupBy("own").agg(rarest.alias("rarest"))  # the skills of one set
    shared = F.size(F.array_intersect("own", "has"))

    first = plan.select("own", F.col("rarest")[0].alias("skill")).join(held, "skill").select("own", "has", "n", shared.alias("shared"))
    reached = first.groupBy("own", "shared").agg(F.sum("n").alias("n"))
    at_least = Window.partitionBy("own").orderBy(F.col("shared").desc())  # a row for each number of shared skills
    bound = reached.withColumn("n", F.sum("n").over(at_least)).filter(F.col("n") >= enough).groupBy("own").agg(F.max("shared").alias("bound"))

    bounded = plan.join(bound, "own", "left").withColumn("bound", F.coalesce("bound", F.lit(1)))
    more = F.slice("rarest", F.lit(2), F.greatest(F.size("rarest") - F.col("bound"), F.lit(0)))
    rest = bounded.select("own", F.explode(more).alias("skill")).join(held, "skill").select("own", "has", shared.alias("shared"))
    found = first.select("own", "has", "shared").unionByName(rest).distinct()
    return found.join(bounded.select("own", "bound"), "own").filter("shared >= bound").drop("bound")


def match_all(
    candidates: DataFrame, jobs: DataFrame, limit: int = lexicon.MATCH_RESULTS, order_columns: list[str] = STORED_ORDER_COLUMNS
) -> DataFrame:
    """(candidate_id, rank, match_score, job_id, shared_skills) as match.match_candidates() ranks them, out of all jobs.

    Jobs are read several times, so they should be a table. Candidates out of bounds and jobs without skills match
    nothing; a candidate_id that repeats is answered for each of its rows.
    """
    check_between("limit", limit, 1)
    order = stored_order(order_columns)
    place = ["freshness_days", "title", *order_columns]
    offered = jobs.select(
        F.col("id").alias("job_id"), _skill_set(F.col("skills")).alias("has"), *place,
        F.coalesce(F.col("remote_type").isin("remote", "hybrid").cast("int"), F.lit(-1)).alias("_remote"),
        F.lower(F.coalesce("location_raw", F.lit(""))).alias("_where"),
    ).filter(F.size("has") > 0)
    fit = check_candidates(candidates).filter("reject_reason IS NULL").select(
        "candidate_id",
        _skill_set(F.transform("skills", lambda s: F.lower(F.trim(s)))).alias("own"),
        F.col("remote_preferred").cast("int").alias("_remote_wish"),
        F.lower(blank_to_null(F.trim("preferred_location"))).alias("_place_wish"),
    ).withColumn("profile", F.to_json(F.struct("own", "_remote_wish", "_place_wish")))
    profiles = fit.select("profile", "own", "_remote_wish", "_place_wish").distinct()

    def first_few(rows: DataFrame, *keys: str) -> DataFrame:
        placed = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        return placed.filter(F.col("_n") <= limit).drop("_n")

    sets = offered.groupBy("has").agg(F.count("*").alias("n"))
    pairs = overlapping(profiles.select("own").distinct(), sets, limit)
    met = profiles.join(pairs, "own")

    anywhere = met.join(first_few(offered, "has", "_remote"), "has")
    wishes = profiles.select(F.col("_place_wish").alias("needle"))
    lying = containing(wishes, offered.select(F.col("_where").alias("text")))
    # of jobs that also lie in the same place only the first few can win, so a place that most jobs share stays small
    placed = first_few(offered, "has", "_remote", "_where")
    there = placed.join(lying.select(F.col("needle").alias("_place_wish"), F.col("text").alias("_where")), "_where")
    nearby = met.join(first_few(there, "has", "_remote", "_place_wish"), ["has", "_place_wish"])
    rows = anywhere.unionByName(nearby).dropDuplicates(["profile", "job_id", *place])

    remote_fit = F.coalesce((F.col("_remote") == F.col("_remote_wish")).cast("int"), F.lit(0))
    place_fit = F.coalesce(F.contains("_where", "_place_wish").cast("int"), F.lit(0))
    best = top_scored(rows, "profile", [F.col("shared").desc(), remote_fit.desc(), place_fit.desc(), *order], limit)
    return fit.select("candidate_id", "profile").join(best, "profile").select(
        "candidate_id", "rank", "match_score", "job_id", F.col("shared").cast("long").alias("shared_skills")
    )
