"""Single rules and boolean formulas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMPONENT_DRUG = "__formula_component__"


def public_rules(rules: DataFrame) -> DataFrame:
    """Without the rules that only serve as parts of formulas (P-4)."""
    return rules.filter(F.col("drug") != COMPONENT_DRUG)


def ruled_features(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Features that some rule is about (P-3)."""
    return features.join(rules.select("feature_id").distinct(), "feature_id", "left_semi")


def match_rules(ann: DataFrame, rules: DataFrame, eps: float = 0.0) -> DataFrame:
    """Rules that exchanges of amino acids fulfil (J-4): same feature, codon and amino acid, not silent, with a frequency.

    A rule without reference amino acid fits any. Rules are shuffled, as their number in memory is not that of their files; of the exchanges only those in features with rules are.
    """
    changed = ruled_features(ann.filter((F.col("consequence") != "synonymous") & (F.col("af") > eps)), rules)
    rule = rules.select("rule_id", "feature_id", F.col("position").alias("codon_pos"), F.col("reference").alias("rule_ref"), F.col("mutation").alias("alt_aa"), "drug", "phenotype", "score", "ic50")
    found = changed.join(rule.hint("shuffle_hash"), ["feature_id", "codon_pos", "alt_aa"])
    return found.filter(F.coalesce(F.col("rule_ref"), F.lit("")).isin("") | (F.col("rule_ref") == F.col("ref_aa"))).drop("rule_ref")


def best_member_evidence(hits: DataFrame, eps: float = 1e-9) -> DataFrame:
    """For each run and rule the evidence with the highest frequency; ties by feature, codon and amino acid (A-7)."""
    w = W.partitionBy("run_id", "rule_id").orderBy(F.desc("af"), "feature_id", "codon_pos", "alt_aa")
    return hits.filter(F.col("af") > eps).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def evaluate_flat_formulas(evidence: DataFrame, members: DataFrame, formulas: DataFrame, min_fraction: float = 2 / 3, eps: float = 1e-9) -> DataFrame:
    """Formulas that join members by one operator (A-8, native form).

    ``members``: ``formula_id, rule_id``; ``formulas``: ``formula_id, op`` (AND, OR). AND fires if all members
    have evidence and the Fréchet bound of their frequencies holds at every step in the order of rule ids; OR fires with the best member.
    """
    n = members.groupBy("formula_id").agg(F.count("*").alias("n"))
    got = evidence.select("run_id", "rule_id", "af").hint("merge").join(members, "rule_id")
    got = got.groupBy("run_id", "formula_id").agg(F.sort_array(F.collect_list(F.struct("rule_id", "af"))).alias("m"))
    got = got.join(formulas.hint("merge"), "formula_id").join(n.hint("merge"), "formula_id")

    def step(s, x):
        total, least, count = s["total"] + x["af"], F.least(s["least"], x["af"]), s["count"] + 1
        lower = F.least(F.greatest(F.lit(0.0), total - (count - 1)), least)
        return F.struct(total.alias("total"), least.alias("least"), count.alias("count"), lower.alias("lower"), (s["ok"] & (lower > eps) & (lower / least >= min_fraction - eps)).alias("ok"))

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("least"), F.lit(0).alias("count"), F.lit(0.0).alias("lower"), F.lit(True).alias("ok"))
    got = got.withColumn("a", F.aggregate("m", zero, step))
    fired = F.when(F.col("op") == "AND", (F.size("m") == F.col("n")) & F.col("a.ok")).otherwise(F.lit(True))
    freq = F.when(F.col("op") == "AND", F.col("a.lower")).otherwise(F.array_max(F.transform("m", lambda x: x["af"])))
    return got.filter(fired).select("run_id", "formula_id", "op", freq.alias("freq"), F.size("m").alias("contributors"))


def effect_hits(ann: DataFrame, effect_rules: DataFrame) -> DataFrame:
    """Consequences that count as resistance to a drug (J-6): same feature, the consequence among the rule's effects."""
    return ann.join(effect_rules.hint("shuffle_hash"), "feature_id").filter(F.array_contains("effects", F.col("consequence")) & (F.col("drug") != "")).drop("effects")
