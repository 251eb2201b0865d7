"""Selections, orderings and summaries of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import label_to_rank, strength


def best_reference(matches: DataFrame) -> DataFrame:
    """One match for each run and query: identity, coverage of the feature, coverage of the query, then the name (W-1)."""
    w = W.partitionBy("run_id", "query").orderBy(F.desc("identity"), F.desc("cds_coverage"), F.desc("query_coverage"), "feature")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key (W-12)."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(time)))).filter("_n = 1").drop("_n")


def unique_names(rows: DataFrame, name: str, by: list[str], order: str) -> DataFrame:
    """Repeated names get the suffixes _2, _3 in order (W-11)."""
    n = F.row_number().over(W.partitionBy(*by, name).orderBy(order))
    return rows.withColumn(name, F.when(n > 1, F.concat_ws("_", name, n.cast("string"))).otherwise(F.col(name)))


def facet_filter(rows: DataFrame, facets: dict[str, list[str]], text: str = "", column: str | None = None) -> DataFrame:
    """All facets, any value inside one, an empty selection is all; free text in one column or in all (P-9)."""
    for name, values in facets.items():
        if values:
            rows = rows.filter(F.col(name).isin(values))
    if text:
        where = F.col(column).cast("string") if column else F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])
        rows = rows.filter(F.lower(where).contains(text.lower()))
    return rows


def facet_options(rows: DataFrame, facets: dict[str, list[str]], field: str) -> DataFrame:
    """Values of a facet that the other facets leave (P-9b)."""
    others = {k: v for k, v in facets.items() if k != field}
    return facet_filter(rows, others).select(field).distinct()


def non_empty_columns(rows: DataFrame) -> DataFrame:
    """Without the columns that are blank throughout (P-10); one pass decides."""
    has = rows.agg(*[F.max(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))).alias(c) for c in rows.columns]).first()
    return rows.select([c for c in rows.columns if has[c]])


def mixed_sort(column: str, ascending: bool = True) -> list[Column]:
    """Sort keys: numbers as numbers and first, other texts without regard to case (O-2)."""
    number, text = F.col(column).try_cast("double"), F.lower(column)
    return [number.asc_nulls_last(), text.asc()] if ascending else [number.desc_nulls_last(), text.desc()]


def top_n_other(rows: DataFrame, label: str, value: str, n: int = 6) -> DataFrame:
    """The n largest labels, the rest as ``Other`` (O-3)."""
    total = rows.groupBy(label).agg(F.sum(value).alias(value))
    top = total.orderBy(F.desc(value), label).limit(n).select(F.col(label).alias("_top"))
    named = total.join(top, F.col(label) == F.col("_top"), "left").withColumn(label, F.coalesce("_top", F.lit("Other")))
    return named.groupBy(label).agg(F.sum(value).alias(value))


def run_summary(ann: DataFrame, hits: DataFrame) -> DataFrame:
    """For each run: exchanges, those that change the protein, hits, and exchanges with a hit (A-16)."""
    a = ann.groupBy("run_id").agg(F.count("*").alias("variants"), F.count_if(F.col("consequence") != "synonymous").alias("non_synonymous"))
    h = hits.groupBy("run_id").agg(F.count("*").alias("hits"), F.count_distinct("feature_id", "codon_pos", "alt_aa").alias("mutations_hit"))
    return a.join(h, "run_id", "left").na.fill(0, ["hits", "mutations_hit"])


def mutation_profile(ann: DataFrame) -> DataFrame:
    """Distinct amino-acid labels of each run and feature in the order of codons (A-15)."""
    label = F.concat("ref_aa", (F.col("codon_pos") + 1).cast("string"), "alt_aa")
    per = ann.filter("consequence != 'synonymous'").groupBy("run_id", "feature_id").agg(F.sort_array(F.collect_set(F.struct("codon_pos", label.alias("label")))).alias("m"))
    return per.select("run_id", "feature_id", F.size("m").alias("n"), F.array_join(F.transform("m", lambda x: x["label"]), ",").alias("labels"))


def expand_formula_tag(ann: DataFrame, flag: str) -> DataFrame:
    """A flag of any member of a codon holds for all its members (W-9)."""
    return ann.withColumn(flag, F.max(flag).over(W.partitionBy("run_id", "feature_id", "codon_pos")))


def kb_breakdown(rules: DataFrame, by: str) -> DataFrame:
    """Rules of each drug, gene or kind (A-23)."""
    return rules.groupBy(by).agg(F.count("*").alias("n"))


def _bins(rows: DataFrame, width: int) -> DataFrame:
    return rows.filter("position is not null").withColumn("bin", F.floor(F.col("position") / width).cast("int"))


def position_histogram(rules: DataFrame, features: DataFrame, width: int = 10) -> DataFrame:
    """Distinct mutations by bin of positions, all features together (A-24).

    Bins reach to the end of the longest of ``features`` (``n_codons``), empty ones kept; positions beyond it have their bins too.
    """
    last = F.ceil(F.max("n_codons") / width).cast("int") - 1
    spine = features.filter("n_codons > 0").agg(last.alias("last")).select(F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    got = _bins(rules, width).groupBy("bin").agg(F.count_distinct("feature_id", "position", "mutation").alias("n"))
    return spine.join(got, "bin", "full").na.fill(0, ["n"])


def position_histogram_by_rank(rules: DataFrame, features: DataFrame, width: int = 10) -> DataFrame:
    """Distinct mutations of each feature by bin of positions and rank of the phenotype (A-24).

    Returns ``feature_id, bin, rank, n, dominant``, with one row of null ranks and n = 0 for each empty bin of a feature's
    length (``n_codons``); positions beyond it have their bins too. The dominant rank of a bin has the most mutations, of several the more severe.
    """
    ends = features.filter("n_codons > 0").groupBy("feature_id").agg((F.ceil(F.max("n_codons") / width).cast("int") - 1).alias("last"))
    spine = ends.select("feature_id", F.explode(F.sequence(F.lit(0), "last")).alias("bin"))
    ranked = _bins(rules, width).withColumn("rank", label_to_rank(F.col("phenotype")))
    got = ranked.groupBy("feature_id", "bin", "rank").agg(F.count_distinct("position", "mutation").alias("n"))
    most = got.groupBy("feature_id", "bin").agg(F.max_by("rank", F.struct("n", strength(F.col("rank")))).alias("dominant"))
    return spine.join(got.join(most, ["feature_id", "bin"]), ["feature_id", "bin"], "full").na.fill(0, ["n"])
