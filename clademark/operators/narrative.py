"""What a report says in words, as plain columns for each run (F-33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import let
from ..functions.sequence import label_to_rank

# The words of the report.
_BEGINS, _NOBODY = "The tested sequence information", "Unknown organism"
_MEANT = " and was evaluated against known resistance-associated mutations"


def listed(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b, and c``; empty for none."""

    def text(x: Column) -> Column:
        most = F.array_join(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), ", ")
        return F.when(F.size(x) == 0, "").when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(F.concat(most, F.when(F.size(x) == 2, " and ").otherwise(", and "), F.element_at(x, -1)))

    return let(items, text)


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, one).otherwise(many))


def narrative(runs: DataFrame, profiled: DataFrame, drugs: DataFrame, labels: DataFrame, gaps: DataFrame, impacts: DataFrame) -> DataFrame:
    """``run_id, lead, uncovered, high_impact`` (texts, empty where there is nothing to say) and ``drugs`` (``label, text``, the most severe label first).

    ``runs``: ``run_id, organism``; ``profiled``: ``run_id, organism, feature``; ``drugs``: ``run_id, drug, assessment`` (blank without one); ``labels``: ``run_id, drug, label``, of the hits; ``gaps``: ``run_id, feature, codon_start,
    codon_end``; ``impacts``: ``run_id`` and, if rows stand for several, ``n``: the changes of high impact that neither rule nor formula explains. Gaps may also be put together
    before, as ``run_id, feature, n``, their codons.

    Features are named with their organisms, those of the first feature first. A drug is listed under its assessment and under each label that its hits have, if the run assesses it; unknown labels say nothing. What is gathered for a run
    are names of a knowledge base.
    """
    organism = F.coalesce(F.nullif(F.trim("organism"), F.lit("")), F.lit(_NOBODY))
    # Names are made distinct by a shuffle before they are gathered, as a run's set would be merged from all tasks.
    each = profiled.select("run_id", organism.alias("o"), F.trim("feature").alias("feature")).distinct().groupBy("run_id", "o").agg(F.array_sort(F.collect_list("feature")).alias("f"))
    clause = F.struct(F.get("f", F.lit(0)).alias("first"), F.concat(listed(F.col("f")), F.lit(" of "), "o").alias("text"))
    mapped = each.groupBy("run_id").agg(listed(F.transform(F.array_sort(F.collect_list(clause)), lambda c: c.text)).alias("mapped"))
    has = F.trim(F.coalesce("assessment", F.lit(""))) != ""
    counts = drugs.groupBy("run_id").agg(F.count("*").alias("all"), F.count_if(has).alias("assessed"))

    assessed = drugs.filter(has)
    said = assessed.select("run_id", "drug", F.trim("assessment").alias("label")).unionByName(labels.join(assessed.select("run_id", "drug").distinct(), ["run_id", "drug"], "left_semi").select("run_id", "drug", F.trim("label").alias("label")))
    said = said.distinct().withColumn("rank", label_to_rank(F.col("label"))).filter("rank <> 0")
    names = said.groupBy("run_id", "rank", "label").agg(F.array_sort(F.collect_set(F.struct(F.lower("drug").alias("k"), "drug"))).alias("d"))
    line = F.struct((-F.col("rank")).alias("order"), "label", F.concat(F.lit("Drugs assessed as "), "label", F.lit(": "), listed(F.transform("d", lambda d: d.drug)), F.lit(".")).alias("text"))
    lists = names.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x.label.alias("label"), x.text.alias("text"))).alias("drugs"))

    codons = F.col("n") if "n" in gaps.columns else F.greatest(F.col("codon_end") - F.col("codon_start") + 1, F.lit(0))
    lost = gaps.groupBy("run_id", "feature").agg(F.sum(codons).alias("n"))
    lost = lost.groupBy("run_id").agg(F.sum("n").cast("long").alias("n"), listed(F.array_sort(F.collect_list("feature"))).alias("f"))
    lost = lost.filter("n > 0").select("run_id", F.concat(F.lit("However, "), _counted(F.col("n"), " position", " positions"), F.lit(" of "), "f", F.lit(" could not be assessed due to incomplete sequence data.")).alias("uncovered"))
    strong = impacts.groupBy("run_id").agg((F.sum("n") if "n" in impacts.columns else F.count("*")).alias("n")).filter("n > 0")
    strong = strong.select("run_id", F.concat(F.lit("Importantly, "), _counted(F.col("n"), " high-impact variant was", " high-impact variants were"), F.lit(" detected and require manual interpretation.")).alias("high_impact"))

    x = runs.select("run_id", organism.alias("o"))
    for part in (mapped, counts, lists, lost, strong):
        x = x.join(part, "run_id", "left")
    begin = F.coalesce(F.concat(F.lit(f"{_BEGINS} mapped to "), "mapped"), F.concat(F.lit(f"{_BEGINS} of "), "o", F.lit(" mapped to no profiled features")))
    end = (
        F.when(F.col("assessed") > 0, F.concat(F.lit(f"{_MEANT} for "), _counted(F.col("assessed"), " drug.", " drugs.")))
        .when(F.col("all") > 0, f"{_MEANT}, but no final drug interpretation algorithm is configured.").otherwise(" and was evaluated, but no in-scope drugs were available for interpretation.")
    )
    none = F.array().cast(lists.schema["drugs"].dataType)
    return x.select("run_id", F.concat(begin, end).alias("lead"), F.coalesce("uncovered", F.lit("")).alias("uncovered"), F.coalesce("high_impact", F.lit("")).alias("high_impact"), F.coalesce("drugs", none).alias("drugs"))
