"""Stored runs: tables by project, and result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Tables

RUN = "run_id string, project_id string, project_uuid string, sample_name string, reference_name string, created_at timestamp, status string"
VARIANT = "feature_id long, codon_pos int, ref_aa string, alt_aa string, consequence string, af double"
GAP = "feature_id long, codon_start int, codon_end int"
FORMULA = "formula_id string, drug string, lower double, members string"
FEATURE = "reference_name string, feature_name string"
SETTING = "method string, reference string, drug string, label string, value double"
#: The lists of a document beside its run, and their columns.
LISTS = {"variant_result": VARIANT, "coverage_gap": GAP, "formula_rule_hit": FORMULA, "profiled_feature": FEATURE, "setting": SETTING}
_struct = lambda columns: f"struct<{columns.replace(' ', ':').replace(',:', ',')}>"
DOCUMENT = f"run {_struct(RUN)}, " + ", ".join(f"{n} array<{_struct(c)}>" for n, c in LISTS.items())


#: Tables of stored runs; all have ``run_id`` and are dealt by it.
RUN_TABLES = ("run", "variant_result", "coverage_gap", "formula_rule_hit", "profiled_feature", "sample_classification")


def save_runs(tables: Tables, batch: str, rows: dict[str, DataFrame]) -> int:
    """Add runs to the tables of ``RUN_TABLES`` in one step (S-12); the version that has them.

    Rows of a run that is there already are replaced, in all tables; a ``batch`` that is there changes nothing.
    """
    unknown = [n for n in rows if n not in RUN_TABLES]
    if unknown or "run" not in rows:
        raise ValueError(f"no tables of runs: {', '.join(unknown)}" if unknown else "the runs themselves are missing")
    ids = rows["run"].select("run_id")
    return tables.commit(batch, {n: (df, "run_id") for n, df in rows.items()}, {n: (ids, ["run_id"]) for n in RUN_TABLES})


def delete_runs(tables: Tables, batch: str, ids: DataFrame) -> int:
    """Delete runs from all their tables in one step (T-3). Only buckets that hold them are written anew; readers of older versions keep theirs."""
    return tables.commit(batch, {}, {n: (ids, ["run_id"]) for n in RUN_TABLES})


def put_rows(tables: Tables, batch: str, name: str, rows: DataFrame, key: list[str], by: str = "run_id") -> int:
    """Rows in place of those of the same key (T-3, K-9)."""
    return tables.commit(batch, {name: (rows, by)}, {name: (rows, key)})


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """A table with new rows in place of those of the same key (T-3, K-9)."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs with their sample and time, the latest first (T-9)."""
    return runs.select("run_id", "project_id", "sample_name", "created_at", "status").orderBy(F.desc("created_at"), "run_id")


def run_documents(runs: DataFrame, variants: DataFrame, gaps: DataFrame, formulas: DataFrame | None = None, profiled: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """One document for each run (S-13): ``run_id, document``, with the lists of ``LISTS``. They are sorted, so that equal runs give equal texts; what is not given is empty.

    ``settings`` are those of projects (``project_id`` and the columns of ``SETTING``), which each of their runs then tells.
    """
    given = {"variant_result": variants, "coverage_gap": gaps, "formula_rule_hit": formulas, "profiled_feature": profiled}
    if settings is not None:
        given["setting"] = runs.select("run_id", "project_id").join(settings, "project_id")
    x = runs
    for name, columns in LISTS.items():
        none = F.array().cast(f"array<{_struct(columns)}>")
        if given.get(name) is None:
            x = x.withColumn(name, none)
            continue
        kinds = [c.split(" ") for c in columns.split(", ")]
        rows = given[name].groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(t).alias(c) for c, t in kinds]))).alias(name))
        x = x.join(rows, "run_id", "left").withColumn(name, F.coalesce(name, none))
    run = F.struct(*[F.col(c.split()[0]) for c in RUN.split(", ")])
    return x.select("run_id", F.to_json(F.struct(run.alias("run"), *LISTS)).alias("document"))


def write_run_json(documents: DataFrame, path: str) -> None:
    """A document on each line (S-13)."""
    documents.select(F.col("document").alias("value")).write.text(path)


def read_run_json(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(runs, variants, gaps, rejected) of result documents, one on each line (S-10). A document without run, its id or the lists of variants and gaps is rejected, with what it lacks."""
    tables, rejected = read_run_tables(spark, paths)
    return tables["run"], tables["variant_result"], tables["coverage_gap"], rejected


def read_run_tables(spark: SparkSession, paths) -> tuple[dict[str, DataFrame], DataFrame]:
    """(``run`` and the tables of ``LISTS``, rejected) of result documents (S-10). Lists that later versions added may be missing."""
    x = spark.read.text(paths).withColumn("d", F.from_json("value", DOCUMENT))
    lack = F.when(F.col("d.run.run_id").isNull(), "run").when(F.col("d.variant_result").isNull(), "variant_result").when(F.col("d.coverage_gap").isNull(), "coverage_gap")
    x = x.withColumn("lacks", lack)
    good = x.filter("lacks is null")
    tables = {n: good.select(F.col("d.run.run_id").alias("run_id"), F.inline(f"d.{n}")) for n in LISTS}
    return {"run": good.select("d.run.*"), **tables}, x.filter("lacks is not null").select("value", "lacks")
