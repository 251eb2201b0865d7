"""Checks and upkeep of stored runs, over all of them at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import numbered


def check_fingerprint(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Does each run belong to the knowledge base as it is now (J-16)? Adds ``ok``: the run's ``project_uuid`` is blank or that of its project."""
    known = projects.select("project_id", F.col("uuid").alias("_uuid"))
    x = runs.join(known, "project_id", "left")
    blank = F.coalesce(F.trim("project_uuid"), F.lit("")) == ""
    return x.withColumn("ok", blank | F.coalesce(F.col("project_uuid") == F.col("_uuid"), F.lit(False))).drop("_uuid")


def stale_runs(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Adds ``stale``: the project was updated after the run was made (T-8); false for a project that is not there."""
    known = projects.select("project_id", F.col("updated_at").alias("_updated"))
    return runs.join(known, "project_id", "left").withColumn("stale", F.coalesce(F.col("_updated") > F.col("created_at"), F.lit(False))).drop("_updated")


def expired_runs(runs: DataFrame, now, hours: float = 24) -> tuple[DataFrame, DataFrame]:
    """(runs to keep, runs older than ``hours`` before ``now``) for a retention job (T-10); runs without time are kept."""
    old = F.coalesce(F.col("created_at") < F.lit(now) - F.make_dt_interval(hours=F.lit(int(hours))), F.lit(False))
    return runs.filter(~old), runs.filter(old)


def check_comparable(runs: DataFrame, by: str = "selection") -> DataFrame:
    """For each selection of runs: how many there are, of how many projects, and whether they compare (M-2): one project, two runs or more."""
    x = runs.select(by, "run_id", "project_id").distinct()
    counts = x.groupBy(by).agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("project_id").alias("projects"))
    return counts.withColumn("comparable", (F.col("projects") == 1) & (F.col("runs") >= 2))


def dedupe_projected(calls: DataFrame) -> DataFrame:
    """One call for each run, place and allele (W-1b): the best alignment's; ``collapsed`` counts the others."""
    key = ["run_id", "chrom", "pos", "ref", "alt"]
    best = F.desc("identity"), F.desc("cds_coverage"), F.desc("query_coverage"), F.asc("feature")
    w = W.partitionBy(key)
    x = calls.withColumns({"_n": F.row_number().over(w.orderBy(*best)), "collapsed": F.count("*").over(w) - 1})
    return x.filter("_n = 1").drop("_n")


def species_collisions(matches: DataFrame) -> DataFrame:
    """Features that a run matches in several organisms (A-19); a profile needs this to be empty."""
    x = matches.groupBy("run_id", "feature").agg(F.array_join(F.array_sort(F.collect_set("organism")), ",").alias("organisms"), F.count_distinct("organism").alias("n"))
    return x.filter("n > 1").drop("n")


def feature_index(mutations: DataFrame) -> DataFrame:
    """Number of each feature in the ordered list of mutations, from 0 (M-3)."""
    return numbered(mutations.select("feature_id").distinct(), ["feature_id"], "index", start=0)
