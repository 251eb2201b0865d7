"""Statistics of result tables and knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .ranks import numbered

# Consequences that count as high impact.
HIGH_IMPACT = ("frameshift", "start_lost", "stop_gained", "stop_loss")


def sequence_assessment(ann: DataFrame) -> DataFrame:
    """For each run: annotations, those that change the protein, features these are in, and high-impact counts by class (A-14)."""
    changed = F.col("consequence") != "synonymous"
    counts = [F.count_if(F.col("consequence") == c).alias(c) for c in HIGH_IMPACT]
    return ann.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(changed).alias("non_synonymous"), F.count_distinct(F.when(changed, F.col("feature_id"))).alias("features"), *counts
    )


def drug_stats(hits: DataFrame) -> DataFrame:
    """Single and formula hits of each run and drug without regard to case, under the name seen first (A-10). ``hits``: ``run_id, seq, drug, is_formula``."""
    return hits.groupBy("run_id", F.lower("drug").alias("key")).agg(
        F.min_by("drug", F.struct("seq", "drug")).alias("drug"), F.count_if(~F.col("is_formula")).alias("single_hits"), F.count_if("is_formula").alias("formula_hits")
    ).drop("key")


def feature_stats(ann: DataFrame, hits: DataFrame, formulas: DataFrame) -> DataFrame:
    """For each run and feature: distinct mutations, hits, and fired formulas, each once (A-11). ``formulas``: ``run_id, feature_id, formula_id``.

    Rows of ``hits`` that stand for several have their number as ``n``. Exchanges are shuffled once, by run and feature.
    """
    key = ["run_id", "feature_id"]
    each = ann.filter("consequence != 'synonymous'").select(*key, "codon_pos", "ref_aa", "alt_aa").repartition(*key).distinct()
    seen = each.groupBy(key).agg(F.count("*").alias("mutations"))
    hit = hits.groupBy(key).agg((F.sum("n") if "n" in hits.columns else F.count("*")).alias("hits"))
    fired = formulas.groupBy(key).agg(F.count_distinct("formula_id").alias("formulas"))
    return seen.join(hit, key, "full").join(fired, key, "full").na.fill(0)


def drugs_in_scope(profiled: DataFrame, rules: DataFrame) -> DataFrame:
    """Drugs that some rule on a run's profiled features is about, hit or not (J-18)."""
    ruled = rules.filter("drug != ''").select("feature_id", "drug").distinct()
    return profiled.select("run_id", "feature_id").distinct().join(ruled, "feature_id").select("run_id", "drug").distinct()


def resolve_thresholds(pairs: DataFrame, overrides: DataFrame, default: object) -> DataFrame:
    """Thresholds of each reference and drug (K-2): an override for both, else one for the drug, else the default.

    ``pairs``: ``reference, drug``; ``overrides``: ``override_no, reference`` (null: any), ``drug, thresholds``. Names are
    compared without case and versions; of equally specific overrides the last one holds. An override table is a settings
    list, and it is put together by its key before the joins, so that each pair meets at most two rows.
    """
    key = {"_r": F.lower(S.accession_base(F.col("reference"))), "_d": F.lower(F.trim("drug"))}
    last = overrides.withColumns(key).groupBy("_r", "_d").agg(F.max_by("thresholds", "override_no").alias("_t"))
    own = last.filter("_r is not null").withColumnRenamed("_t", "_own")
    common = last.filter("_r is null").select("_d", F.col("_t").alias("_common"))
    x = pairs.withColumns(key).join(own, ["_r", "_d"], "left").join(common, "_d", "left")
    source = F.when(F.col("_own").isNotNull(), "reference and drug").when(F.col("_common").isNotNull(), "drug").otherwise("default")
    return x.withColumns({"thresholds": F.coalesce("_own", "_common", F.lit(default)), "source": source}).drop("_r", "_d", "_own", "_common")


def suppress_any_insertion(hits: DataFrame) -> DataFrame:
    """Without hits of ``INS_any`` where a specific insertion fires for the same annotation, position and drug (W-5)."""
    wild = F.col("mutation") == "INS_any"
    specific = ~wild & (F.length("mutation") > F.length("reference"))
    key = ["ann_id", "position", "drug"]
    named = hits.filter(specific).select(*key).distinct()
    return hits.filter(~wild).unionByName(hits.filter(wild).join(named, key, "left_anti").select(hits.columns))


def ic50_distribution(rules: DataFrame, by: list[str]) -> DataFrame:
    """Range of log10 values of each group (A-25): IC50 where the group has any, else fold; what is not positive is counted and left out."""
    has = rules.groupBy(by).agg((F.count("ic50") > 0).alias("has"))
    x = rules.join(has, by).withColumn("v", F.when(F.col("has"), F.col("ic50")).otherwise(F.col("fold_ic50"))).filter("v is not null")
    log = F.when(F.col("v") > 0, F.log10("v"))
    metric = F.when(F.col("has"), "ic50").otherwise("fold_ic50")
    return x.groupBy(*by, metric.alias("metric")).agg(
        F.count(log).alias("n"), F.count_if(F.col("v") <= 0).alias("skipped"), F.min(log).alias("low"), F.avg(log).alias("mean"), F.max(log).alias("high")
    )


def consolidate_drugs(drugs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drugs of one name but for case become that of the smallest id, and rules follow (A-29). ``drugs``: ``drug_id, name``; ``rules``: ``drug_id`` and more."""
    least = drugs.groupBy(F.lower("name").alias("_k")).agg(F.min("drug_id").alias("_to"))
    moved = drugs.withColumn("_k", F.lower("name")).join(least, "_k").select("drug_id", "_to")
    kept = drugs.join(least, F.col("drug_id") == F.col("_to"), "left_semi")
    out = rules.join(moved, "drug_id", "left").withColumn("drug_id", F.coalesce("_to", "drug_id")).drop("_to")
    return kept, out


def condense_effects(effects: DataFrame) -> DataFrame:
    """Effects and drugs of each feature, sorted and joined by ``, `` (A-28)."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ", ").alias(f"{c}s")
    return effects.groupBy("feature_id").agg(joined("effect"), joined("drug"))


def publications(rows: DataFrame, column: str = "publication") -> DataFrame:
    """Publications of a comma-separated text as ``doi, pmid, raw`` (F-23); empty entries are dropped."""
    x = rows.withColumn("raw", F.explode(F.split(column, ","))).withColumn("raw", F.trim("raw")).filter("raw != ''")
    return x.withColumns({"doi": S.doi_of(F.col("raw")), "pmid": S.pmid_of(F.col("raw"))})


def number_bibliography(cited: DataFrame, key: str = "raw") -> DataFrame:
    """Publications numbered by first appearance (W-10). ``cited``: ``row_no`` and ``key``."""
    return numbered(cited.groupBy(key).agg(F.min("row_no").alias("first")), ["first", key])


def score_histogram(rules: DataFrame, by: list[str]) -> DataFrame:
    """Rules of each group by score, with zeros for scores that occur elsewhere only (A-26).

    The grid has a row for each group and distinct score of the knowledge base, which is what the report shows.
    """
    counts = rules.filter("score is not null").groupBy(*by, "score").agg(F.count("*").alias("n"))
    grid = rules.select(by).distinct().crossJoin(counts.select("score").distinct())
    return grid.join(counts, [*by, "score"], "left").na.fill(0, ["n"])


def kb_catalog(rules: DataFrame, by: str = "db") -> DataFrame:
    """For each knowledge base its rules, genes and sorted drugs (A-27)."""
    return rules.groupBy(by).agg(F.count("*").alias("rules"), F.count_distinct("gene").alias("genes"), F.array_join(F.array_sort(F.collect_set("drug")), ",").alias("drugs"))
