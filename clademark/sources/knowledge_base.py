"""A knowledge base as one set of tables that fit each other (S-11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ensure_schema
from .versions import Tables


@dataclass(frozen=True)
class Table:
    """What a table must have: columns with their types and defaults, those that it may not lack, its key, and which tables its columns point to."""

    columns: str
    required: tuple[str, ...]
    key: tuple[str, ...]
    links: tuple[tuple[str, str, str], ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()


_LABELS = "phenotype string, clinical_phenotype string, ic50 string, fold_ic50 string, score string, source string, comment string"
CATALOG: dict[str, Table] = {
    "reference": Table("reference_name string, accession string, length int, organism string, taxonomy string", ("reference_name",), ("reference_name",)),
    "feature": Table(
        "feature_id long, name string, reference_name string, accession string, locus_tag string, protein_id string, protein string, aa_sequence string, has_rules boolean", ("feature_id", "name"), ("feature_id",),
        (("reference_name", "reference", "reference_name"),), (("has_rules", False),),
    ),
    "segment": Table("feature_id long, segment_index int, start int, end int", ("feature_id", "start", "end"), ("feature_id", "segment_index"), (("feature_id", "feature", "feature_id"),), (("segment_index", 0),)),
    "rule": Table(f"rule_id long, feature_id long, drug string, member_id string, reference_identifier string, position int, reference string, mutation string, {_LABELS}", ("rule_id", "feature_id", "drug", "position", "mutation"), ("rule_id",), (("feature_id", "feature", "feature_id"), ("drug", "drug", "drug"))),
    "formula": Table(f"formula_no long, formula_id string, drug string, label string, canonical string, {_LABELS}", ("formula_no", "drug", "canonical"), ("formula_no",), (("drug", "drug", "drug"),)),
    "formula_member": Table("formula_no long, rule_id long", ("formula_no", "rule_id"), ("formula_no", "rule_id"), (("formula_no", "formula", "formula_no"), ("rule_id", "rule", "rule_id"))),
    "drug": Table("drug string", ("drug",), ("drug",)),
    "publication": Table("publication_id long, key string, doi string, pmid string, raw string, title string, year int", ("publication_id",), ("publication_id",)),
    "rule_publication": Table("rule_id long, publication_id long", ("rule_id", "publication_id"), ("rule_id", "publication_id"), (("rule_id", "rule", "rule_id"), ("publication_id", "publication", "publication_id"))),
    "formula_publication": Table("formula_no long, publication_id long", ("formula_no", "publication_id"), ("formula_no", "publication_id"), (("formula_no", "formula", "formula_no"), ("publication_id", "publication", "publication_id"))),
}


def load(tables: Tables, catalog: dict[str, Table] | None = None, version: int | None = None) -> dict[str, DataFrame]:
    """All tables of a catalog from one version (the latest): missing columns get their defaults, missing tables are empty (S-11, T-4).

    A table that lacks a required column is an error. The version is fixed at the call, so that tables belong together while others write.
    """
    catalog = CATALOG if catalog is None else catalog
    version = tables.version() if version is None else version
    have, out = tables.manifest(version)["tables"], {}
    for name, table in catalog.items():
        schema = T.StructType.fromDDL(table.columns)
        if name not in have:
            out[name] = tables.spark.createDataFrame([], schema)
            continue
        try:
            out[name] = ensure_schema(tables.read(name, version), schema, table.required, dict(table.defaults))
        except ValueError as e:
            raise ValueError(f"{name}: {e}") from None
    return out


def broken(loaded: dict[str, DataFrame], catalog: dict[str, Table] | None = None) -> DataFrame:
    """What does not fit: ``table, column, value, problem`` with the problems ``missing`` (a required value), ``repeated`` (a key) and ``no <table>`` (a link to nothing), and the number ``n`` of rows.

    Keys and links are joined on themselves; a null link points to nothing and is none.
    """
    catalog = CATALOG if catalog is None else catalog
    found = []
    for name, table in catalog.items():
        df = loaded[name]
        row = lambda column, value, problem: [F.lit(name).alias("table"), F.lit(column).alias("column"), value.cast("string").alias("value"), F.lit(problem).alias("problem")]  # noqa: B023, E731
        for c in table.required:
            found.append(df.filter(F.col(c).isNull()).select(*row(c, F.lit(None), "missing")))
        again = df.groupBy(*table.key).agg(F.count("*").alias("_n")).filter("_n > 1")
        found.append(again.select(*row(",".join(table.key), F.concat_ws(",", *[F.col(c).cast("string") for c in table.key]), "repeated")))
        for c, other, key in table.links:
            there = loaded[other].select(F.col(key).alias(c)).distinct()
            found.append(df.filter(F.col(c).isNotNull()).join(there, c, "left_anti").select(*row(c, F.col(c), f"no {other}")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("table", "column", "value", "problem").agg(F.count("*").alias("n"))


def with_segments(loaded: dict[str, DataFrame]) -> DataFrame:
    """Features with their segments as one ordered list (S-11); a feature without has an empty one."""
    s = loaded["segment"].groupBy("feature_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "start", "end"))), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("segments"))
    return loaded["feature"].join(s, "feature_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast("array<struct<start:int,end:int>>")))
