"""From calls in genome coordinates to codon and amino-acid consequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from .intervals import interval_join


def filter_calls(calls: DataFrame, min_af: float = 0.01, min_depth: int = 10) -> DataFrame:
    """Calls with enough frequency and depth; a depth of -1 is no information and passes (P-1)."""
    return calls.filter((F.col("af") >= min_af) & ((F.col("depth") < 0) | (F.col("depth") >= min_depth)))


def locate_in_features(calls: DataFrame, segments: DataFrame, bin: int = 512) -> DataFrame:
    """Coding position of each call in each feature whose segments hold it (J-1).

    ``segments``: ``chrom, feature_id, strand, start, end, cds_offset``, where the offset is the coding length of the
    segments before it in coding order. A call without feature stays with null feature and position. Segments are as many as genomes are
    long, so they are shuffled: a broadcast would lie in the driver.
    """
    found = interval_join(calls, segments.hint("shuffle_hash"), ["chrom"], bin=bin, how="left")
    cds = F.when(F.col("strand") == "+", F.col("cds_offset") + F.col("pos") - F.col("start")).otherwise(F.col("cds_offset") + F.col("end") - 1 - F.col("pos"))
    return found.withColumn("cds_pos", cds)


def coding_segments(segments: DataFrame) -> DataFrame:
    """Add ``cds_offset`` to ``chrom, feature_id, strand, start, end``: segments follow the strand."""
    from pyspark.sql import Window as W

    order = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("start"))
    before = W.partitionBy("feature_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return segments.withColumn("cds_offset", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)))


def annotate_snps(located: DataFrame, features: DataFrame | None = None, all_calls: bool = False) -> DataFrame:
    """Codons, amino acids and consequence of single exchanges (F-6, F-5).

    ``features``: ``feature_id, codon_start, nt_sequence`` in coding orientation, or none if ``located`` has them already (from its segments, which saves to move the calls
    once more). An allele on the reverse strand is complemented. What equals the reference base is no exchange and is left out,
    or, with ``all_calls``, stays without a consequence, so that depth and exchanges come from one pass.
    """
    x = located.filter("feature_id is not null")
    x = x if features is None else x.join(features.hint("shuffle_hash"), "feature_id")
    start = F.coalesce("codon_start", F.lit(0))
    codon, place = S.codon_index(F.col("cds_pos"), start), S.codon_position(F.col("cds_pos"), start)
    base = F.when(F.col("strand") == "-", S.complement(F.col("alt"))).otherwise(F.upper("alt"))
    x = x.withColumns({"codon_pos": codon, "codon_offset": place, "coding_alt": base})
    x = x.withColumn("ref_codon", F.upper(S.letters(F.col("nt_sequence"), F.col("codon_pos") * 3 + start + 1, F.lit(3)))).drop("nt_sequence")
    changed = F.substring("ref_codon", F.col("codon_offset") + 1, F.lit(1)) != F.col("coding_alt")
    x = x if all_calls else x.filter(changed)
    x = x.withColumn("alt_codon", F.overlay("ref_codon", "coding_alt", F.col("codon_offset") + 1, F.lit(1)))
    # The 64 codons as a broadcast table: as an expression, the translation would be repeated wherever an amino acid is used.
    codons = x.sparkSession.createDataFrame(list(S.CODONS.items()), "codon string, aa string")
    for side in ("ref", "alt"):
        table = F.broadcast(codons.select(F.col("codon").alias(f"{side}_codon"), F.col("aa").alias(f"{side}_aa")))
        x = x.join(table, f"{side}_codon", "left").withColumn(f"{side}_aa", F.coalesce(f"{side}_aa", F.lit("?")))
    kind = S.classify_snp(F.col("ref_aa"), F.col("alt_aa"), F.col("codon_pos"))
    return x.withColumn("consequence", F.when(changed, kind) if all_calls else kind)
