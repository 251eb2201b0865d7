"""Registered queries of insertions and deletions, written mutations and stored runs; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles
from ..operators import annotate, cohort, indels, report, rules
from . import fixtures
from .catalog import _AA, _B, W_ANN, annotations, query
from .fixtures import fixture
from .reports import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

_RUN = lambda a, b: f"array_to_string(list_transform(range(CAST({a} AS BIGINT), CAST({b} AS BIGINT)), lambda i: {_B('i')}), '')"
_PEPTIDE = lambda s: f"array_to_string(list_transform(range(length({s}) // 3), lambda j: {_AA(f'substr({s}, CAST(j * 3 + 1 AS INT), 3)')}), '')"
W_INDEL = f"""c AS ({fixtures.oracle('indel_calls')}), feature AS ({fixtures.oracle('feature')}),
 l AS (SELECT c.*, feature_id, CASE WHEN strand = '+' THEN pos - f_start ELSE f_end - 1 - pos - length(ref) END AS anchor, length(alt) > length(ref) AS ins, strand FROM c JOIN feature f ON c.chrom = f.chrom AND pos >= f_start AND pos < f_end WHERE length(ref) <> length(alt)),
 a AS (SELECT *, CAST(anchor // 3 AS INT) AS codon_pos, CAST(anchor % 3 AS INT) + 1 AS k, (length(alt) - length(ref)) % 3 <> 0 AS fs, CASE WHEN ins THEN substr(alt, 2) ELSE substr(ref, 2) END AS g FROM l WHERE anchor >= 0),
 b AS (SELECT *, CASE WHEN strand = '-' THEN reverse(translate(g, 'ACGT', 'TGCA')) ELSE g END AS bases, {_RUN('codon_pos * 3', 'codon_pos * 3 + 3')} AS ref_codon, codon_pos * 3 + k + length(g) AS behind FROM a),
 d AS (SELECT *, NOT ins AND k < 3 AND behind + 3 - k > 600 AS beyond, substr(ref_codon, 1, k) || bases || substr(ref_codon, k + 1) AS opened FROM b),
 e AS (SELECT *, CASE WHEN fs OR beyond THEN ref_codon WHEN ins THEN substr(opened, 1, 3) ELSE substr(ref_codon, 1, k) || {_RUN('behind', 'behind + 3 - k')} END AS codon,
  CASE WHEN ins THEN substr(opened, 4) WHEN k = 3 THEN bases ELSE {_RUN('codon_pos * 3 + 3', 'least(600, codon_pos * 3 + 3 + length(g) // 3 * 3)')} END AS moved FROM d),
 f AS (SELECT *, {_AA('ref_codon')} AS aa, {_AA('codon')} AS new_aa, {_PEPTIDE('moved')} AS peptide FROM e),
 ann AS (SELECT run_id, feature_id, codon_pos, ref_codon, codon AS alt_codon, aa AS ref_aa, new_aa AS alt_aa, CASE WHEN codon_pos = 0 AND aa = 'M' THEN 'start_lost' WHEN new_aa = '*' THEN 'stop_gained' WHEN aa = '*' THEN 'stop_loss' ELSE 'missense' END AS consequence, af FROM f WHERE aa <> new_aa
  UNION ALL SELECT run_id, feature_id, codon_pos, ref_codon, '', CASE WHEN fs OR beyond OR ins THEN aa ELSE aa || peptide END, CASE WHEN fs THEN aa || 'fsX' WHEN beyond THEN '?' WHEN ins THEN aa || peptide ELSE aa END, CASE WHEN fs THEN 'frameshift' WHEN ins THEN 'insertion' ELSE 'deletion' END, af FROM f)"""


def indel_annotations(spark, d, about=None):
    """Insertions and deletions in all features, or in those that the rules ``about`` are about."""
    segments = annotate.coding_segments(fixtures.segments(spark, d))
    segments = segments if about is None else rules.ruled_features(segments, about)
    segments = segments.join(fixtures.features(spark, d).hint("shuffle_hash"), "feature_id")
    placed = annotate.locate_in_features(fixture(spark, d, "indel_calls"), segments)
    return indels.annotate_indels(placed).select("run_id", "feature_id", "codon_pos", "ref_codon", "alt_codon", "ref_aa", "alt_aa", "consequence", "af")


@query(f"WITH {W_INDEL} SELECT * FROM ann")
def f7_annotate_indels(spark, d):
    return indel_annotations(spark, d)


_REST = lambda short, long: f"CASE WHEN starts_with({long}, {short}) THEN substr({long}, length({short}) + 1) ELSE right({long}, length({long}) - length({short})) END"
W_FIT = f"""r AS ({fixtures.oracle('indel_rules')}), fit AS (SELECT a.run_id, r.rule_id, a.feature_id, a.codon_pos, a.ref_aa, a.alt_aa, a.consequence, a.af, r.drug, r.reference FROM ann a JOIN r ON a.feature_id = r.feature_id AND a.codon_pos = r.position
 WHERE a.af > 0 AND CASE WHEN consequence = 'frameshift' THEN mutation = 'fsX' WHEN mutation = 'INS_any' THEN consequence = 'insertion'
  WHEN consequence = 'insertion' AND length(mutation) > length(reference) THEN {_REST('reference', 'mutation')} = {_REST('ref_aa', 'alt_aa')}
  WHEN consequence = 'deletion' AND length(reference) > length(mutation) THEN CASE WHEN length(ref_aa) <= length(alt_aa) THEN '' ELSE {_REST('alt_aa', 'ref_aa')} END = {_REST('mutation', 'reference')}
  WHEN length(reference) > length(mutation) THEN ref_aa = reference ELSE alt_aa = mutation END)"""


def indel_hits(spark, d):
    r = fixture(spark, d, "indel_rules")
    return indels.match_allele_rules(indel_annotations(spark, d, r), r)


@query(f"WITH {W_INDEL}, {W_FIT} SELECT run_id, rule_id, feature_id, codon_pos, ref_aa, alt_aa, consequence, af, drug FROM fit")
def f12_match_allele_rules(spark, d):
    return indel_hits(spark, d).select("run_id", "rule_id", "feature_id", "codon_pos", "ref_aa", "alt_aa", "consequence", "af", "drug")


@query(f"""WITH {W_INDEL}, {W_FIT}, j AS (SELECT a.run_id, r.rule_id, a.feature_id, a.codon_pos, a.consequence, r.reference, r.mutation, a.ref_aa, a.alt_aa FROM ann a JOIN r ON a.feature_id = r.feature_id AND a.codon_pos = r.position WHERE a.af > 0 AND a.alt_aa <> '')
 SELECT run_id, rule_id, feature_id, codon_pos, consequence, reference AS expected, ref_aa AS observed FROM j WHERE consequence = 'insertion' AND length(mutation) > length(reference) AND ref_aa <> reference
 UNION ALL SELECT run_id, rule_id, feature_id, codon_pos, consequence, mutation, alt_aa FROM j WHERE consequence = 'deletion' AND length(reference) > length(mutation) AND alt_aa <> mutation""")
def f12b_anchor_mismatches(spark, d):
    r = fixture(spark, d, "indel_rules")
    return indels.anchor_mismatches(indel_annotations(spark, d, r), r)


@query(f"""SELECT p_partkey, CASE kind WHEN 0 THEN '*' WHEN 1 THEN 'fsX' WHEN 2 THEN 'F' || CAST(position AS VARCHAR) || 'FGG' WHEN 3 THEN 'FGG' || CAST(position AS VARCHAR) || 'F' WHEN 4 THEN 'L'
 WHEN 5 THEN raw WHEN 6 THEN raw WHEN 9 THEN 'INS_any' WHEN 10 THEN 'K' || CAST(position AS VARCHAR) || 'KGG' WHEN 12 THEN 'K' END AS mutation FROM ({fixtures.oracle('tokens')})""")
def f8_normalize_mutation(spark, d):
    return fixture(spark, d, "tokens").select("p_partkey", alleles.normalize_mutation(F.col("raw"), F.col("reference"), F.col("position")).alias("mutation"))


W_RUNS = f"r AS ({fixtures.oracle('runs')}), p AS ({fixtures.oracle('projects')})"


@query(f"WITH {W_RUNS} SELECT run_id, r.project_id, coalesce(project_uuid = '' OR project_uuid = uuid, FALSE) AS ok FROM r LEFT JOIN p ON r.project_id = p.project_id")
def j16_check_fingerprint(spark, d):
    return cohort.check_fingerprint(fixture(spark, d, "runs"), fixture(spark, d, "projects")).select("run_id", "project_id", "ok")


@query(f"WITH {W_RUNS} SELECT run_id, coalesce(updated_at > created_at, FALSE) AS stale FROM r LEFT JOIN p ON r.project_id = p.project_id")
def t8_stale_runs(spark, d):
    return cohort.stale_runs(fixture(spark, d, "runs"), fixture(spark, d, "projects")).select("run_id", "stale")


@query(f"WITH {W_RUNS} SELECT run_id FROM r WHERE created_at >= TIMESTAMP '1996-01-01 12:00:00' - INTERVAL 24 HOUR")
def t10_retention(spark, d):
    import datetime

    return cohort.expired_runs(fixture(spark, d, "runs"), datetime.datetime(1996, 1, 1, 12))[0].select("run_id")


@query(f"WITH {W_RUNS} SELECT selection, count(DISTINCT run_id) AS runs, count(DISTINCT project_id) AS projects, count(DISTINCT project_id) = 1 AND count(DISTINCT run_id) >= 2 AS comparable FROM r GROUP BY selection")
def m2_check_comparable(spark, d):
    return cohort.check_comparable(fixture(spark, d, "runs"))


@query(f"SELECT run_id, chrom, pos, ref, alt, identity, cds_coverage, query_coverage, feature, count(*) OVER (PARTITION BY run_id, chrom, pos, ref, alt) - 1 AS collapsed FROM ({fixtures.oracle('projected')}) QUALIFY row_number() OVER (PARTITION BY run_id, chrom, pos, ref, alt ORDER BY identity DESC, cds_coverage DESC, query_coverage DESC, feature) = 1")
def w1b_dedupe_projected(spark, d):
    return cohort.dedupe_projected(fixture(spark, d, "projected").drop("organism"))


@query(f"SELECT run_id, feature, string_agg(DISTINCT organism, ',' ORDER BY organism) AS organisms FROM ({fixtures.oracle('projected')}) GROUP BY ALL HAVING count(DISTINCT organism) > 1")
def a19_species_collisions(spark, d):
    return cohort.species_collisions(fixture(spark, d, "projected"))


@query(f"WITH {W_ANN} SELECT feature_id, CAST(row_number() OVER (ORDER BY feature_id) - 1 AS INT) AS index FROM (SELECT DISTINCT feature_id FROM ann)")
def m3_feature_index(spark, d):
    return cohort.feature_index(annotations(spark, d))


@query(f"WITH r AS ({fixtures.oracle('rules')}), s AS (SELECT DISTINCT score FROM r WHERE score IS NOT NULL), g AS (SELECT DISTINCT drug FROM r) SELECT g.drug, s.score, count(r.rule_id) AS n FROM g CROSS JOIN s LEFT JOIN r ON r.drug = g.drug AND r.score = s.score GROUP BY ALL")
def a26_score_histogram(spark, d):
    return report.score_histogram(fixture(spark, d, "rules"), ["drug"])


@query(f"SELECT db, count(*) AS rules, count(DISTINCT gene) AS genes, string_agg(DISTINCT drug, ',' ORDER BY drug) AS drugs FROM ({fixtures.oracle('kbs')}) GROUP BY db")
def a27_kb_catalog(spark, d):
    return report.kb_catalog(fixture(spark, d, "kbs"))
