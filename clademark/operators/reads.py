"""Codon states that reads show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import interval_join
from .liftover import cigar_blocks

#: Flags of reads that are no molecules of their own: secondary, failed, duplicate, supplementary.
SKIPPED = 0x100 | 0x200 | 0x400 | 0x800


def observed_states(reads: DataFrame, places: DataFrame, min_mapq: int = 20, min_depth: int = 10, bin: int = 256) -> DataFrame:
    """How often molecules carry each combination of bases at a codon's places (A-3).

    ``reads``: ``run_id, chrom, qname, flag, pos, mapq, cigar, seq``; ``places``: ``run_id, chrom, codon, strand, at`` (positions, ascending). A read counts where it spans all
    places and has a base at each. Reads of one name are a molecule: two that differ are rejected, of more than two the first (in order of their bases) counts.
    Returns ``run_id, codon, bases`` (in coding orientation), ``n, molecules, freq``; codons with fewer than ``min_depth`` molecules give nothing, and rare
    combinations stay in the denominator. Codons of a run with the same places show the same: they are counted once, for one of them, and told for each.
    """
    same = places.groupBy("run_id", "codon").agg(F.sort_array(F.collect_list(F.struct("chrom", "strand", "at"))).alias("_places"))
    chosen = same.groupBy("run_id", "_places").agg(F.min("codon").alias("_codon"))
    members = same.join(chosen, ["run_id", "_places"]).select("run_id", "codon", "_codon")
    places = chosen.select("run_id", F.col("_codon").alias("codon"), F.inline("_places"))
    good = reads.filter((F.col("flag").bitwiseAND(F.lit(SKIPPED)) == 0) & (F.coalesce("mapq", F.lit(0)) >= min_mapq))
    # Generated rows are made once; a column would be made again for the filter and for each use.
    good = good.select("*", F.explode(F.array(cigar_blocks(F.col("cigar")))).alias("_b")).filter(F.size("_b") > 0)
    stop = F.col("pos") + F.element_at("_b", -1)["t"] + F.element_at("_b", -1)["n"]
    good = good.select("run_id", "chrom", "qname", "pos", "seq", "_b", stop.alias("_stop"))
    first = places.withColumn("_first", F.array_min("at"))
    x = interval_join(first, good.withColumnRenamed("pos", "_start"), ["run_id", "chrom"], point="_first", start="_start", end="_stop", bin=bin)
    x = x.filter(F.array_max("at") < F.col("_stop"))

    def base(p):
        t = p - F.col("_start")
        b = F.get(F.filter("_b", lambda b: (t >= b["t"]) & (t < b["t"] + b["n"])), F.lit(0))
        return F.upper(F.substring("seq", (b["q"] + t - b["t"] + 1).cast("int"), F.lit(1)))

    minus = F.col("strand") == "-"
    ordered = F.when(minus, F.reverse("at")).otherwise(F.col("at"))
    shown = F.transform(ordered, lambda p: F.when(minus, F.translate(base(p), "ACGT", "TGCA")).otherwise(base(p)))
    x = x.select("*", F.explode(F.array(shown)).alias("_s")).filter(~F.exists("_s", lambda s: s.isNull() | (s == "")))
    x = x.select("run_id", "codon", "qname", F.array_join("_s", "").alias("bases"))
    one = x.groupBy("run_id", "codon", "qname").agg(F.count("*").alias("n"), F.min("bases").alias("bases"), F.max("bases").alias("other"))
    one = one.filter("n <> 2 or bases = other")
    per = one.groupBy("run_id", "codon", "bases").agg(F.count("*").alias("n"))
    total = per.groupBy("run_id", "codon").agg(F.sum("n").alias("molecules")).filter(F.col("molecules") >= min_depth)
    found = per.join(total, ["run_id", "codon"]).withColumn("freq", F.col("n") / F.col("molecules"))
    return found.withColumnRenamed("codon", "_codon").join(members, ["run_id", "_codon"]).select("run_id", "codon", "bases", "n", "molecules", "freq")
