"""From query coordinates to coding positions, through alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alleles import let
from .intervals import interval_join

_BLOCK = "struct<q:int,t:int,n:int>"


def cigar_ops(cigar: Column) -> Column:
    """Operations of a CIGAR text in order, as ``n, op`` (F-14)."""
    pick = lambda group: F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), group)
    return F.zip_with(pick(F.lit(1)), pick(F.lit(2)), lambda n, op: F.struct(n.cast("int").alias("n"), op.alias("op")))


def cigar_blocks(cigar: Column) -> Column:
    """Aligned runs: start ``q`` in the query, ``t`` in the target, length ``n``, all 0-based from the alignment's start."""

    def step(s, o):
        aligned, n = o["op"].isin("M", "=", "X"), o["n"]
        block = F.struct(s["q"].alias("q"), s["t"].alias("t"), n.alias("n"))
        return F.struct(
            (s["q"] + F.when(aligned | o["op"].isin("I", "S"), n).otherwise(0)).alias("q"),
            (s["t"] + F.when(aligned | o["op"].isin("D", "N"), n).otherwise(0)).alias("t"),
            F.when(aligned, F.concat(s["blocks"], F.array(block))).otherwise(s["blocks"]).alias("blocks"),
        )

    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("t"), F.array().cast(f"array<{_BLOCK}>").alias("blocks"))
    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: s["blocks"])


def cds_to_genomic(segments: Column, strand: Column, cds: Column) -> Column:
    """Genomic place of a coding position: ``segments`` (``start, end``, ascending) are walked in coding order; null outside."""
    ordered = F.when(strand == "-", F.reverse(segments)).otherwise(segments)

    def step(s: Column, seg: Column) -> Column:
        n = seg["end"] - seg["start"]
        at = F.when(strand == "-", seg["end"] - 1 - s["left"]).otherwise(seg["start"] + s["left"])
        here = s["at"].isNull() & (s["left"] >= 0) & (s["left"] < n)
        return F.struct((s["left"] - n).alias("left"), F.when(here, at).otherwise(s["at"]).cast("long").alias("at"))

    return F.aggregate(ordered, F.struct(cds.cast("long").alias("left"), F.lit(None).cast("long").alias("at")), step, lambda s: s["at"])


def remap_calls(calls: DataFrame, matches: DataFrame, bin: int = 512) -> DataFrame:
    """Coding position of calls in query coordinates (J-2).

    ``matches``: ``chrom, feature_id, strand, query_start, query_end, cds_start, cigar``, the CIGAR in coding
    orientation. Each call gets a row for each match that spans it, with ``cds_pos``; what cannot be placed has
    null there and a ``reason``: ``insertion`` (no target base) or ``outside`` (no match spans it).
    """
    span = matches.select("chrom", "feature_id", "strand", F.col("query_start").alias("start"), F.col("query_end").alias("end"), "cds_start", cigar_blocks(F.col("cigar")).alias("blocks"))
    x = interval_join(calls, span, ["chrom"], bin=bin, how="left")
    x = x.withColumn("_rel", F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("pos")).otherwise(F.col("pos") - F.col("start")).cast("int"))
    hit = F.get(F.filter("blocks", lambda b: (F.col("_rel") >= b["q"]) & (F.col("_rel") < b["q"] + b["n"])), F.lit(0))
    x = x.withColumn("_hit", hit)
    cds = F.col("cds_start") + F.col("_hit.t") + F.col("_rel") - F.col("_hit.q")
    reason = F.when(F.col("feature_id").isNull(), "outside").when(F.col("_hit").isNull(), "insertion")
    return x.withColumns({"cds_pos": cds, "reason": reason}).drop("_rel", "_hit", "blocks", "start", "end", "cds_start")


def route_calls(calls: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls whose contig has a query record, and the contigs of the others with their calls (J-3). ``records``: ``chrom``."""
    names = records.select("chrom").distinct()
    dropped = calls.join(names, "chrom", "left_anti").groupBy("run_id", "chrom").agg(F.count("*").alias("calls"))
    return calls.join(names, "chrom", "left_semi"), dropped


def pair_inputs(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """Call files and read files of one stem (J-20): ``paired``, ``unmatched`` or ``collision`` if a side has several. Both: ``stem, path``."""
    side = lambda df, name: df.groupBy(F.lower("stem").alias("stem")).agg(F.min("path").alias(name), F.count("*").alias(f"n_{name}"))
    both = side(calls, "calls").join(side(reads, "reads"), "stem", "full").na.fill(0, ["n_calls", "n_reads"])
    status = F.when(F.greatest("n_calls", "n_reads") > 1, "collision").when((F.col("n_calls") == 1) & (F.col("n_reads") == 1), "paired").otherwise("unmatched")
    return both.withColumn("status", status)


def project_calls(calls: DataFrame, matches: DataFrame, features: DataFrame, bin: int = 512) -> DataFrame:
    """Calls in query coordinates as calls on the genome of the knowledge base (J-2): ``g_pos, g_ref, g_alt, cds_pos, reason``.

    ``calls``: ``run_id, chrom, pos, ref, alt``; ``matches`` as for ``remap_calls``; ``features``: ``feature_id, strand, nt_sequence, segments``. A call gets a row for each match that spans it. Where the query runs
    against the genome, alleles turn round, and an insertion or deletion takes the base on its other side as anchor. What cannot be placed has a ``reason``:
    ``no match`` (no match has the place), ``not coding`` (the place is in no exon) or ``no anchor``.
    """
    span = matches.select("chrom", "feature_id", F.col("strand").alias("_strand"), F.col("query_start").alias("start"), F.col("query_end").alias("end"), "cds_start", cigar_blocks(F.col("cigar")).alias("blocks"))
    x = interval_join(calls, span, ["chrom"], bin=bin)
    x = x.join(features.select("feature_id", F.col("strand").alias("_own"), F.upper("nt_sequence").alias("_cds"), "segments"), "feature_id")

    def place(p: Column) -> Column:
        rel = F.when(F.col("_strand") == "-", F.col("end") - 1 - p).otherwise(p - F.col("start")).cast("int")
        return let(F.get(F.filter("blocks", lambda b: (rel >= b["q"]) & (rel < b["q"] + b["n"])), F.lit(0)), lambda b: F.col("cds_start") + b["t"] + rel - b["q"])

    turned, sized = F.col("_strand") != F.col("_own"), (F.length("ref") != 1) | (F.length("alt") != 1)
    x = x.withColumns({"_here": place(F.col("pos")), "_last": place(F.col("pos") + F.length("ref") - 1), "_turned": turned, "_sized": sized})
    other = F.col("_last") + F.when(F.col("_own") == "-", 1).otherwise(-1)
    cds = F.when(F.col("_here").isNull(), None).when(F.col("_turned") & F.col("_sized"), F.when(other >= 0, other)).otherwise(F.col("_here"))
    x = x.withColumn("cds_pos", cds).withColumn("g_pos", cds_to_genomic(F.col("segments"), F.col("_own"), F.col("cds_pos")))
    letter = F.substring("_cds", F.col("cds_pos") + 1, F.lit(1))
    x = x.withColumn("_anchor", F.when(F.col("_own") == "-", S.complement(letter)).otherwise(letter))
    rest = lambda c: S.reverse_complement(F.substring(c, 2, 2**30))
    longer = F.length("alt") > F.length("ref")
    switched = F.col("_turned") & F.col("_sized")
    flip = lambda c: F.concat(S.complement(F.substring(c, 1, 1)), rest(c))
    ref = F.when(switched, F.when(longer, F.col("_anchor")).otherwise(F.concat("_anchor", rest("ref")))).when(F.col("_turned"), flip("ref")).otherwise(F.col("ref"))
    alt = F.when(switched, F.when(longer, F.concat("_anchor", rest("alt"))).otherwise(F.col("_anchor"))).when(F.col("_turned"), flip("alt")).otherwise(F.col("alt"))
    reason = F.when(F.col("cds_pos").isNull(), "no match").when(F.col("g_pos").isNull(), "not coding").when(switched & (F.col("_anchor") == ""), "no anchor")
    fine = reason.isNull()
    x = x.withColumns({"g_ref": F.when(fine, ref), "g_alt": F.when(fine, alt), "reason": reason})
    return x.drop("start", "end", "cds_start", "blocks", "segments", *[c for c in x.columns if c.startswith("_")])
