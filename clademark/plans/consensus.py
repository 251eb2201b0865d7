"""Registered queries of consensus sequences: a sequence with known changes for each feature, called back through its alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import consensus
from . import fixtures
from .catalog import _B, query, r6
from .fixtures import fixture

#: What is done to each feature's sequence: shared by both sides as numbers, applied by each in its own way.
EDITS = "SELECT feature_id, strand, f_start, CAST(feature_id % 4 AS INT) AS c0, CAST(600 - feature_id % 3 AS INT) AS c1, CAST(60 + feature_id % 30 AS INT) AS snp_at, CAST(200 + feature_id % 7 AS INT) AS del_at, CAST(3 * (1 + feature_id % 2) AS INT) AS del_n, CAST(300 + feature_id % 5 AS INT) AS ins_at FROM ({feature})"


def sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, queries, features)"""
    fixture(spark, d, "feature").createOrReplaceTempView("_consensus_feature")
    e = spark.sql(EDITS.format(feature="SELECT * FROM _consensus_feature")).join(fixtures.features(spark, d), "feature_id")
    seq, at = F.col("nt_sequence"), F.col("snp_at")
    letter = F.when(F.col("feature_id") % 3 == 0, "R").otherwise(F.translate(F.substring(seq, at + 1, F.lit(1)), "ACGT", "CGTA"))
    seq = F.overlay(seq, letter, at + 1, F.lit(1))
    seq = F.when(F.col("feature_id") % 2 == 0, F.overlay(seq, F.lit("NNN"), F.lit(91), F.lit(3))).otherwise(seq)
    part = lambda a, b: F.substring(seq, a + 1, b - a)
    gone = F.col("del_at") + F.col("del_n")
    region = F.concat(part(F.col("c0"), F.col("del_at")), part(gone, F.col("ins_at")), F.lit("GGA"), part(F.col("ins_at"), F.lit(400)), F.repeat(F.lit("A"), F.lit(40)), part(F.lit(400), F.col("c1")))
    cigar = F.format_string("%dM%dD%dM3I%dM40I%dM", F.col("del_at") - F.col("c0"), F.col("del_n"), F.col("ins_at") - gone, F.lit(400) - F.col("ins_at"), F.col("c1") - 400)
    e = e.withColumns({"region": region, "cigar": cigar, "run_id": F.col("feature_id") % 50, "query": F.format_string("q%d", F.col("feature_id"))})
    text = F.concat(F.lit("CC"), F.when(F.col("strand") == "-", S.reverse_complement(F.col("region"))).otherwise(F.col("region")), F.lit("TT"))
    seg = lambda a, b: F.struct((F.col("f_start") + a).alias("start"), (F.col("f_start") + b).alias("end"))
    segments = F.when(F.col("strand") == "-", F.array(seg(0, 200), seg(240, 640))).otherwise(F.array(seg(0, 400), seg(440, 640)))
    matches = e.select("run_id", "query", "feature_id", "strand", F.lit(2).alias("query_start"), (F.length("region") + 2).alias("query_end"), F.col("c0").alias("cds_start"), "cigar")
    return matches, e.select("run_id", "query", text.alias("sequence")), e.select("feature_id", "strand", "codon_start", "nt_sequence", segments.alias("segments"))


def _aligned(spark, d):
    return consensus.aligned(*sequences(spark, d))


_RUN = lambda a, n: f"array_to_string(list_transform(range(CAST({n} AS BIGINT)), lambda i: {_B(f'({a} + i)')}), '')"
_G = lambda p: f"CASE WHEN strand = '-' THEN f_start + CASE WHEN {p} < 400 THEN 639 ELSE 599 END - {p} ELSE f_start + {p} + CASE WHEN {p} >= 400 THEN 40 ELSE 0 END END"
_C = lambda s: f"CASE WHEN strand = '-' THEN translate({s}, 'ACGT', 'TGCA') ELSE {s} END"
_RC = lambda s: f"CASE WHEN strand = '-' THEN reverse(translate({s}, 'ACGT', 'TGCA')) ELSE {s} END"
W_E = f"e AS ({EDITS.format(feature=fixtures.oracle('feature'))})"
W_CALLED = f"""{W_E}, s AS (SELECT *, {_B('snp_at')} AS r FROM e), a AS (SELECT *, unnest(CASE WHEN feature_id % 3 = 0 THEN ['A', 'G'] ELSE [translate(r, 'ACGT', 'CGTA')] END) AS alt FROM s),
 i AS (SELECT *, CASE WHEN strand = '-' THEN ins_at ELSE ins_at - 1 END AS anc FROM e), k AS (SELECT *, CASE WHEN strand = '-' THEN del_at + del_n ELSE del_at - 1 END AS anc, {_RUN('del_at', 'del_n')} AS gone FROM e),
 called AS (SELECT feature_id, snp_at AS cds_pos, {_G('snp_at')} AS pos, {_C('r')} AS ref, {_C('alt')} AS alt, CASE WHEN feature_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS af FROM a WHERE alt <> r
  UNION ALL SELECT feature_id, anc, {_G('anc')}, {_C(_B('anc'))}, ({_C(_B('anc'))}) || ({_RC("'GGA'")}), 1.0 FROM i
  UNION ALL SELECT feature_id, anc, {_G('anc')}, ({_C(_B('anc'))}) || ({_RC('gone')}), {_C(_B('anc'))}, 1.0 FROM k)"""


@query(f"WITH {W_CALLED} SELECT feature_id, cds_pos, CAST(pos AS BIGINT) AS pos, ref, alt, af FROM called")
def c1_consensus_variants(spark, d):
    return consensus.consensus_variants(_aligned(spark, d)).select("feature_id", "cds_pos", "pos", "ref", "alt", "af")


@query(f"WITH {W_E} SELECT feature_id, 0 AS codon_start, 0 AS codon_end FROM e WHERE c0 > 0 UNION ALL SELECT feature_id, 30, 30 FROM e WHERE feature_id % 2 = 0 UNION ALL SELECT feature_id, 199, 199 FROM e WHERE c1 < 600")
def c2_unassessable_codons(spark, d):
    return consensus.unassessable_codons(_aligned(spark, d)).select("feature_id", "codon_start", "codon_end")


@query(f"WITH {W_E} SELECT feature_id, c1 - c0 - del_n + 3 AS bases, 400 - c0 AS junction, 400 - c0 - del_n + 3 AS start, 40 AS length FROM e")
def c3_introns(spark, d):
    x = _aligned(spark, d)
    n = F.length(F.regexp_replace("query_text", "-", ""))
    return x.select("feature_id", n.alias("bases"), F.inline("introns"))


@query(f"WITH {W_E} SELECT feature_id, 603 AS n, c0 + del_n + 600 - c1 AS query_gaps, 3 AS ref_gaps FROM e")
def c4_gapped_alignment(spark, d):
    gaps = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("-")))
    return _aligned(spark, d).select("feature_id", F.length("ref").alias("n"), gaps("query_text").alias("query_gaps"), gaps("ref").alias("ref_gaps"))


@query(f"WITH {W_E} SELECT feature_id, 'D' AS op, del_at AS cds_pos, del_n AS n FROM e UNION ALL SELECT feature_id, 'I', ins_at, 3 FROM e")
def w3_alignment_runs(spark, d):
    return consensus.alignment_runs(_aligned(spark, d)).select("feature_id", "op", "cds_pos", "n")


@query(f"WITH {W_E} SELECT feature_id, round(500.0 / (c1 - c0), 6) AS identity, round((c1 - c0) / 600.0, 6) AS cds_coverage FROM e")
def f14c_exon_metrics(spark, d):
    x = _aligned(spark, d).withColumn("m", consensus.exon_metrics(F.lit(500), F.lit(640), F.col("ops"), F.col("introns"), F.lit(600)))
    return r6(x.select("feature_id", "m.*"), "identity", "cds_coverage")
