"""Depth and codons without enough of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def base_depth(blocks: DataFrame) -> DataFrame:
    """Depth by position from aligned blocks ``run_id, chrom, start, end`` (A-5).

    Only the places where depth changes are kept: +1 at a start, -1 at an end, summed in order. Returns
    ``run_id, chrom, start, end, depth`` for stretches with reads.
    """
    ends = blocks.select("run_id", "chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("run_id", "chrom", "e.pos").agg(F.sum("e.d").alias("d")).filter("d != 0")
    w = W.partitionBy("run_id", "chrom").orderBy("pos")
    out = steps.select("run_id", "chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w).cast("long").alias("depth"))
    return out.filter("depth > 0")


def uncovered_ranges(features: DataFrame, stretches: DataFrame, min_depth: int = 10) -> DataFrame:
    """Codons of which a base has too little depth, as inclusive ranges ``codon_start, codon_end`` (A-6, W-2).

    ``features``: ``feature_id, n_codons``; ``stretches``: ``run_id, feature_id, start, end, depth`` in coding positions, apart from each other. Each stretch with enough depth gives its
    bases to the codons at its ends, and those between as a range; what lies between whole ones is a gap. Codons inside stretches and gaps are never listed.
    """
    s, e = F.col("start").cast("int"), F.col("end").cast("int")
    first, behind = F.floor(s / 3).cast("int"), F.ceil(e / 3).cast("int")
    part = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
    ends = [part(first, first + 1, (first + 1) * 3 - s), part(behind - 1, behind, e - (behind - 1) * 3)]
    parts = F.when(F.col("depth") < min_depth, F.array(part(F.lit(0), F.lit(1), F.lit(0)))).when(first + 1 >= behind, F.array(part(first, behind, e - s)))
    parts = parts.when(first + 2 == behind, F.array(*ends)).otherwise(F.array(ends[0], part(first + 1, behind - 1, (behind - first - 2) * 3), ends[1]))
    own = ["run_id", "feature_id"]
    x = stretches.select(*own, F.inline(parts)).groupBy(*own, "a", "b").agg(F.sum("n").alias("n"))
    whole = F.when((F.col("n") > 0) & (F.col("n") == (F.col("b") - F.col("a")) * 3), F.struct("a", "b"))
    x = x.groupBy(*own).agg(F.sort_array(F.collect_list(whole)).alias("_w")).join(features.select("feature_id", F.col("n_codons").cast("int").alias("n")), "feature_id")
    x = x.select(*own, "n", F.inline(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("_w.b")).alias("codon_start"), F.concat(F.col("_w.a"), F.array("n")).alias("codon_end"))))
    return x.withColumn("codon_end", F.least("codon_end", "n") - 1).filter("codon_start <= codon_end").drop("n")


def lost_codons(calls: DataFrame, sums: dict[str, Column], min_depth: int = 10) -> DataFrame:
    """How many codons of each run and feature have a base with too little depth (A-6 counted): ``run_id, feature_id, lost`` and ``sums`` over the calls.

    ``calls``: ``run_id, feature_id, n_codons, cds_pos, depth``; depths of one position add. Codons are counted where they are put together, and never listed.
    """
    own = ["run_id", "feature_id", "n_codons"]
    place = F.col("cds_pos") % 3
    depths = [F.sum(F.when(place == i, F.col("depth"))).alias(f"_d{i}") for i in range(3)]
    x = calls.repartition(*own).groupBy(*own, F.floor(F.col("cds_pos") / 3).alias("_codon")).agg(*depths, *(c.alias(k) for k, c in sums.items()))
    whole = (F.col("_codon") >= 0) & (F.col("_codon") < F.col("n_codons")) & (F.least(*(F.coalesce(f"_d{i}", F.lit(min_depth - 1)) for i in range(3))) >= min_depth)
    x = x.groupBy(*own).agg(F.count_if(whole).alias("_whole"), *(F.sum(k).alias(k) for k in sums))
    return x.select("run_id", "feature_id", (F.col("n_codons") - F.col("_whole")).alias("lost"), *sums)


def uncovered_codons(features: DataFrame, stretches: DataFrame, min_depth: int = 10) -> DataFrame:
    """The codons of ``uncovered_ranges``, one by one (A-6)."""
    gaps = uncovered_ranges(features, stretches, min_depth)
    return gaps.select("run_id", "feature_id", F.explode(F.sequence("codon_start", "codon_end")).alias("codon_pos"))


def merge_codon_gaps(codons: DataFrame) -> DataFrame:
    """Codons (``codon_pos``) or ranges of them (``codon_start, codon_end``) that meet, as inclusive ranges (W-2). Ranges are never listed."""
    x = codons if "codon_start" in codons.columns else codons.withColumns({"codon_start": F.col("codon_pos"), "codon_end": F.col("codon_pos")})
    own = W.partitionBy("run_id", "feature_id").orderBy("codon_start", "codon_end")
    before = F.max("codon_end").over(own.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_new", F.coalesce(before + 1 < F.col("codon_start"), F.lit(True)).cast("int"))
    x = x.withColumn("g", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return x.groupBy("run_id", "feature_id", "g").agg(F.min("codon_start").alias("codon_start"), F.max("codon_end").alias("codon_end")).drop("g")


def gene_coverage(gaps: DataFrame, features: DataFrame) -> DataFrame:
    """Percentage of a feature's codons outside gaps, rounded half to even (A-13)."""
    lost = gaps.groupBy("run_id", "feature_id").agg(F.sum(F.col("codon_end") - F.col("codon_start") + 1).alias("lost"))
    n = F.col("n_codons")
    share = F.when(n == 0, 100.0).otherwise(F.bround((n - F.least("lost", n)) * 100 / n, 0))
    return lost.join(features, "feature_id").select("run_id", "feature_id", share.cast("int").alias("coverage"))
