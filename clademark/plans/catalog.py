"""Registered queries of the engine's operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import annotate, codon, compare, coverage, interpret, rules, tables
from ..streaming.ingest import submissions_per_minute
from . import fixtures
from .fixtures import fixture

ANN = ["run_id", "feature_id", "codon_pos", "codon_offset", "ref_codon", "alt_codon", "coding_alt", "ref_aa", "alt_aa", "consequence", "af", "depth"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def located(spark: SparkSession, d: str) -> DataFrame:
    calls = annotate.filter_calls(fixture(spark, d, "calls"))
    return annotate.locate_in_features(calls, annotate.coding_segments(fixtures.segments(spark, d)))


def annotations(spark: SparkSession, d: str, about: DataFrame | None = None) -> DataFrame:
    """Exchanges in all features, or in those that the rules ``about`` are about."""
    return annotate.annotate_snps(with_sequences(spark, d, about)).select(ANN)


def with_sequences(spark: SparkSession, d: str, about: DataFrame | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Calls in features, with the sequences of these and their columns ``also``."""
    calls, segments = annotate.filter_calls(fixture(spark, d, "calls")), annotate.coding_segments(fixtures.segments(spark, d))
    segments = segments if about is None else rules.ruled_features(segments, about)
    return annotate.locate_in_features(calls, segments.join(fixtures.features(spark, d, *also).hint("shuffle_hash"), "feature_id"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    r = fixture(spark, d, "rules")
    return rules.match_rules(annotations(spark, d, r), r)


_B = lambda i: f"substr('ACGT', CAST({fixtures.BASE.format(i=i, f='feature_id')} AS INT) + 1, 1)"
_AA = lambda c: f"substr('{S.GENETIC_CODE}', 16 * (instr('TCAG', substr({c}, 1, 1)) - 1) + 4 * (instr('TCAG', substr({c}, 2, 1)) - 1) + instr('TCAG', substr({c}, 3, 1)), 1)"
W_CALLS = f"calls AS (SELECT * FROM ({fixtures.oracle('calls')}) WHERE af >= 0.01 AND (depth < 0 OR depth >= 10)), feature AS ({fixtures.oracle('feature')}), located AS (SELECT c.*, f.feature_id, f.strand, f.f_start, f.f_end, CASE WHEN strand = '+' THEN pos - f_start ELSE f_end - 1 - pos END AS cds_pos FROM calls c LEFT JOIN feature f ON c.chrom = f.chrom AND pos >= f_start AND pos < f_end)"
W_ANN = W_CALLS + f""", a0 AS (SELECT *, CAST(floor(cds_pos / 3) AS INT) AS codon_pos, cds_pos % 3 AS codon_offset, CASE WHEN strand = '-' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS coding_alt FROM located WHERE feature_id IS NOT NULL),
 a1 AS (SELECT *, {_B('(codon_pos * 3)')} || {_B('(codon_pos * 3 + 1)')} || {_B('(codon_pos * 3 + 2)')} AS ref_codon FROM a0),
 a2 AS (SELECT *, substr(ref_codon, 1, codon_offset) || coding_alt || substr(ref_codon, codon_offset + 2) AS alt_codon FROM a1 WHERE substr(ref_codon, codon_offset + 1, 1) <> coding_alt),
 a3 AS (SELECT *, {_AA('ref_codon')} AS ref_aa, {_AA('alt_codon')} AS alt_aa FROM a2),
 ann AS (SELECT run_id, feature_id, codon_pos, codon_offset, ref_codon, alt_codon, coding_alt, ref_aa, alt_aa, CASE WHEN ref_aa = alt_aa THEN 'synonymous' WHEN codon_pos = 0 AND ref_aa = 'M' THEN 'start_lost' WHEN alt_aa = '*' THEN 'stop_gained' WHEN ref_aa = '*' THEN 'stop_loss' ELSE 'missense' END AS consequence, af, depth FROM a3)"""
W_HITS = W_ANN + f", rules AS ({fixtures.oracle('rules')}), hits AS (SELECT a.*, r.rule_id, r.drug, r.phenotype, r.score, r.ic50 FROM ann a JOIN rules r ON a.feature_id = r.feature_id AND a.codon_pos = r.position AND a.alt_aa = r.mutation WHERE consequence <> 'synonymous' AND af > 0)"
RANK = "CASE phenotype WHEN 'susceptible' THEN 1 WHEN 'possibly resistant' THEN 2 WHEN 'intermediate' THEN 4 WHEN 'resistant' THEN 5 WHEN 'contradictory' THEN -1 ELSE 0 END"
STRENGTH = "CASE WHEN rank = -1 THEN 1.5 ELSE rank END"


@query(f"WITH {W_CALLS} SELECT * FROM calls")
def p1_filter_calls(spark, d):
    return annotate.filter_calls(fixture(spark, d, "calls"))


@query(f"WITH {W_CALLS} SELECT run_id, chrom, pos, alt, af, depth, feature_id, cds_pos FROM located")
def j1_locate_in_features(spark, d):
    return located(spark, d).select("run_id", "chrom", "pos", "alt", "af", "depth", "feature_id", "cds_pos")


@query(f"WITH {W_ANN} SELECT * FROM ann")
def f6_annotate_snps(spark, d):
    return annotations(spark, d)


W_PLACES = W_ANN + """, per AS (SELECT run_id, feature_id, codon_pos, ref_codon, codon_offset, coding_alt AS base, max(af) AS af FROM ann GROUP BY ALL),
 opts AS (SELECT *, 1 AS changed FROM per UNION ALL SELECT run_id, feature_id, codon_pos, ref_codon, codon_offset, substr(ref_codon, codon_offset + 1, 1), greatest(0, 1 - sum(af)), 0 FROM per GROUP BY run_id, feature_id, codon_pos, ref_codon, codon_offset),
 grp AS MATERIALIZED (SELECT run_id, feature_id, codon_pos, ref_codon, count(DISTINCT codon_offset) AS k FROM per GROUP BY ALL HAVING count(DISTINCT codon_offset) >= 2),
 lists AS MATERIALIZED (SELECT g.run_id, g.feature_id, g.codon_pos, g.ref_codon, g.k, list({'o': o.codon_offset, 'base': o.base, 'af': o.af, 'changed': o.changed} ORDER BY o.changed DESC, o.base) AS l FROM grp g JOIN opts o ON o.run_id = g.run_id AND o.feature_id = g.feature_id AND o.codon_pos = g.codon_pos GROUP BY ALL),
 wide AS (SELECT run_id, feature_id, codon_pos, ref_codon, k, """ + ", ".join(f"CASE WHEN len(list_filter(l, lambda q: q.o = {i})) > 0 THEN list_filter(l, lambda q: q.o = {i}) ELSE [{{'o': {i}, 'base': substr(ref_codon, {i + 1}, 1), 'af': 1.0, 'changed': 0}}] END AS l{i}" for i in range(3)) + """ FROM lists),
 three AS (SELECT run_id, feature_id, codon_pos, ref_codon, k, l0, l1, l2, unnest(range(len(l0) * len(l1) * len(l2))) AS state_no FROM wide),
 pick AS (SELECT *, l0[CAST(state_no // (len(l1) * len(l2)) AS INT) + 1] AS x, l1[CAST(state_no // len(l2) % len(l1) AS INT) + 1] AS y, l2[CAST(state_no % len(l2) AS INT) + 1] AS z FROM three),
 s0 AS MATERIALIZED (SELECT run_id, feature_id, codon_pos, ref_codon, k, state_no, x.base || y.base || z.base AS codon, least(x.af, y.af, z.af) AS upper, x.changed + y.changed + z.changed AS size, greatest(0, x.af + y.af + z.af - 2) AS low FROM pick),
 s1 AS (SELECT *, least(low, upper) AS lower FROM s0),
 states AS (SELECT *, CASE WHEN upper = 0 THEN 0 ELSE lower / upper END AS forced, """ + _AA("codon") + " AS aa FROM s1)"


@query(f"WITH {W_PLACES} SELECT run_id, feature_id, codon_pos, ref_codon, k AS places FROM grp")
def a1_codon_groups(spark, d):
    x = codon.codon_groups(annotations(spark, d))
    return x.select("run_id", "feature_id", "codon_pos", "ref_codon", F.size("places").cast("long").alias("places"))


@query(f"WITH {W_PLACES} SELECT run_id, feature_id, codon_pos, codon, aa, size, round(lower, 6) AS lower, round(upper, 6) AS upper, (lower > 1e-6 AND lower / nullif(upper, 0) >= 2.0 / 3 - 1e-6) IS TRUE AS accepted FROM states")
def a2_frechet_states(spark, d):
    x = codon.frechet_states(codon.codon_groups(annotations(spark, d)), eps=1e-6)
    return r6(x, "lower", "upper").select("run_id", "feature_id", "codon_pos", "codon", "aa", "size", "lower", "upper", "accepted")


@query(f"WITH {W_PLACES} SELECT run_id, feature_id, codon_pos, aa, round(sum(lower), 6) AS lower, round(max(upper), 6) AS upper, arg_min(codon, state_no) AS codon FROM states GROUP BY run_id, feature_id, codon_pos, aa")
def a4_dedupe_states(spark, d):
    x = codon.dedupe_states(codon.frechet_states(codon.codon_groups(annotations(spark, d))))
    return r6(x, "lower", "upper").drop("forced")


@query(f"WITH {W_HITS} SELECT run_id, rule_id, feature_id, codon_pos, alt_aa, af, drug, phenotype FROM hits")
def j4_match_rules(spark, d):
    return hits(spark, d).select("run_id", "rule_id", "feature_id", "codon_pos", "alt_aa", "af", "drug", "phenotype")


W_BEST = W_HITS + ", ev AS (SELECT run_id, rule_id, max(af) AS af FROM hits GROUP BY ALL)"


@query(f"WITH {W_BEST} SELECT * FROM ev")
def a7_best_member_evidence(spark, d):
    return rules.best_member_evidence(hits(spark, d)).select("run_id", "rule_id", "af")


W_FLAT = """g AS (SELECT run_id, formula_id, op, count(*) AS contributors, greatest(0, sum(af) - 1) AS low, min(af) AS smallest, max(af) AS largest FROM members JOIN ev USING (rule_id) JOIN formulas USING (formula_id) GROUP BY ALL),
 flat AS (SELECT run_id, formula_id, op, round(CASE WHEN op = 'AND' THEN least(low, smallest) ELSE largest END, 6) AS freq, contributors FROM g
 WHERE op = 'OR' OR (contributors = 2 AND low > 1e-6 AND least(low, smallest) / smallest >= 2.0 / 3 - 1e-6))"""


@query(f"WITH {W_BEST}, members AS ({fixtures.oracle('members')}), formulas AS ({fixtures.oracle('formulas')}), {W_FLAT} SELECT * FROM flat")
def a8_flat_formulas(spark, d):
    ev = rules.best_member_evidence(hits(spark, d))
    x = rules.evaluate_flat_formulas(ev, fixture(spark, d, "members"), fixture(spark, d, "formulas"), eps=1e-6)
    return r6(x, "freq").withColumn("contributors", F.col("contributors").cast("long"))


@query(f"WITH {W_ANN}, effects AS ({fixtures.oracle('effects')}) SELECT a.run_id, a.feature_id, a.codon_pos, a.consequence, e.drug FROM ann a JOIN effects e ON a.feature_id = e.feature_id AND a.consequence = e.effect")
def j6_effect_hits(spark, d):
    e = fixture(spark, d, "effects").groupBy("feature_id", "drug").agg(F.collect_list("effect").alias("effects"))
    return rules.effect_hits(annotations(spark, d), e).select("run_id", "feature_id", "codon_pos", "consequence", "drug")


@query(f"WITH {W_HITS} SELECT run_id, drug, count(*) AS hit_count, sum(score) AS score, max(ic50) AS max_ic50, " + ", ".join(f"count(*) FILTER ({RANK} = {r}) AS rank_{r if r >= 0 else 'contradictory'}" for r in (5, 4, 3, 2, 1, 0, -1)) + " FROM hits GROUP BY ALL")
def a9_drug_table(spark, d):
    return interpret.drug_table(hits(spark, d))


W_K3 = W_HITS + f", lab AS (SELECT run_id, drug, {RANK} AS rank, phenotype AS label, count(*) AS n FROM hits GROUP BY ALL), k3 AS (SELECT run_id, drug, rank, label FROM lab QUALIFY row_number() OVER (PARTITION BY run_id, drug ORDER BY {STRENGTH} DESC, n DESC, label) = 1)"
W_K4 = W_K3 + ", dt AS (SELECT run_id, drug, sum(score) AS score, max(ic50) AS max_ic50 FROM hits GROUP BY ALL), k4 AS (SELECT run_id, drug, CASE WHEN score >= 30 THEN 5 WHEN score >= 15 THEN 4 ELSE 1 END AS rank, CASE WHEN score >= 30 THEN 'resistant' WHEN score >= 15 THEN 'intermediate' ELSE 'susceptible' END AS label FROM dt), k5 AS (SELECT run_id, drug, CASE WHEN max_ic50 >= 18 THEN 5 WHEN max_ic50 >= 12 THEN 4 ELSE 1 END AS rank, CASE WHEN max_ic50 >= 18 THEN 'resistant' WHEN max_ic50 >= 12 THEN 'intermediate' ELSE 'susceptible' END AS label FROM dt)"
T = "label string, value double"
SCORES, IC50S = [("susceptible", 0.0), ("intermediate", 15.0), ("resistant", 30.0)], [("susceptible", 0.0), ("intermediate", 12.0), ("resistant", 18.0)]


@query(f"WITH {W_K3} SELECT * FROM k3")
def k3_by_phenotype(spark, d):
    return interpret.assess_by_phenotype(hits(spark, d))


@query(f"WITH {W_K4} SELECT * FROM k4")
def k4_by_score(spark, d):
    return interpret.assess_by_value(interpret.drug_table(hits(spark, d)), spark.createDataFrame(SCORES, T))


@query(f"WITH {W_K4} SELECT * FROM k5")
def k5_by_ic50(spark, d):
    return interpret.assess_by_value(interpret.drug_table(hits(spark, d)), spark.createDataFrame(IC50S, T), "max_ic50")


@query(f"WITH {W_K4}, al AS (SELECT *, 1 AS method_no FROM k3 UNION ALL SELECT *, 2 FROM k4 UNION ALL SELECT *, 3 FROM k5) SELECT run_id, drug, rank, label, method_no FROM al QUALIFY row_number() OVER (PARTITION BY run_id, drug ORDER BY {STRENGTH} DESC, method_no) = 1")
def k6_final_call(spark, d):
    """The flagship: from calls to one assessment for each run and drug."""
    return interpret.assess_drugs(hits(spark, d), {"score": spark.createDataFrame(SCORES, T), "ic50": spark.createDataFrame(IC50S, T)})


@query(f"SELECT round(avg(ic50), 6) AS mean, round(stddev_samp(ic50), 6) AS std, count(*) AS n FROM ({fixtures.oracle('rules')})")
def a12_metric_stats(spark, d):
    return r6(interpret.metric_stats(fixture(spark, d, "rules"), "ic50"), "mean", "std")


@query(f"WITH r AS ({fixtures.oracle('rules')}), s AS (SELECT avg(ic50) AS m, stddev_samp(ic50) AS sd FROM r) SELECT rule_id, CASE WHEN ic50 <= m THEN 1 WHEN ic50 <= m + sd THEN 2 WHEN ic50 <= m + 2 * sd THEN 3 ELSE 4 END AS tier FROM r, s")
def a12b_metric_tier(spark, d):
    x = fixture(spark, d, "rules")
    return x.crossJoin(interpret.metric_stats(x, "ic50")).select("rule_id", interpret.metric_tier(F.col("ic50"), F.col("mean"), F.col("std")).alias("tier"))


@query(f"WITH b AS ({fixtures.oracle('blocks')}), e AS (SELECT run_id, chrom, b_start AS pos, 1 AS d FROM b UNION ALL SELECT run_id, chrom, b_end, -1 FROM b), s AS (SELECT run_id, chrom, pos, sum(d) AS d FROM e GROUP BY ALL HAVING sum(d) <> 0), w AS (SELECT run_id, chrom, pos AS block_start, lead(pos) OVER (PARTITION BY run_id, chrom ORDER BY pos) AS block_end, CAST(sum(d) OVER (PARTITION BY run_id, chrom ORDER BY pos) AS BIGINT) AS depth FROM s) SELECT * FROM w WHERE depth > 0")
def a5_base_depth(spark, d):
    b = fixture(spark, d, "blocks").withColumnsRenamed({"b_start": "start", "b_end": "end"})
    return coverage.base_depth(b).withColumnsRenamed({"start": "block_start", "end": "block_end"})


W_GAPS = W_CALLS + """, depth AS (SELECT run_id, feature_id, cds_pos AS pos, sum(depth) AS depth FROM located WHERE feature_id IS NOT NULL GROUP BY ALL),
 spine AS (SELECT r.run_id, r.feature_id, CAST(t.i AS INT) AS codon_pos FROM (SELECT DISTINCT run_id, feature_id FROM depth) r CROSS JOIN range(200) t(i)),
 fine AS (SELECT run_id, feature_id, CAST(floor(pos / 3) AS INT) AS codon_pos FROM depth WHERE depth >= 10 GROUP BY ALL HAVING count(DISTINCT pos) = 3),
 bare AS (SELECT * FROM spine ANTI JOIN fine USING (run_id, feature_id, codon_pos)),
 isl AS (SELECT *, codon_pos - row_number() OVER (PARTITION BY run_id, feature_id ORDER BY codon_pos) AS g FROM bare),
 gaps AS (SELECT run_id, feature_id, min(codon_pos) AS codon_start, max(codon_pos) AS codon_end FROM isl GROUP BY run_id, feature_id, g)"""


def stretches(spark: SparkSession, d: str) -> DataFrame:
    # Dealt as the gaps need it, so that summing and finding them is one shuffle.
    depth = located(spark, d).filter("feature_id is not null").repartition("run_id", "feature_id").groupBy("run_id", "feature_id", F.col("cds_pos").cast("int").alias("start")).agg(F.sum("depth").alias("depth"))
    return depth.withColumn("end", F.col("start") + 1)


def uncovered(spark: SparkSession, d: str) -> DataFrame:
    return coverage.uncovered_codons(fixture(spark, d, "feature"), stretches(spark, d))


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return coverage.uncovered_ranges(fixture(spark, d, "feature"), stretches(spark, d))


@query(f"WITH {W_GAPS} SELECT * FROM bare")
def a6_uncovered_codons(spark, d):
    return uncovered(spark, d)


@query(f"WITH {W_GAPS} SELECT * FROM gaps")
def w2_merge_codon_gaps(spark, d):
    return coverage.merge_codon_gaps(gaps(spark, d))


@query(f"WITH {W_GAPS} SELECT run_id, feature_id, CAST(round_even((200 - sum(codon_end - codon_start + 1)) * 100.0 / 200, 0) AS INT) AS coverage FROM gaps GROUP BY ALL")
def a13_gene_coverage(spark, d):
    return coverage.gene_coverage(gaps(spark, d), fixture(spark, d, "feature"))


@query(f"WITH {W_GAPS.replace(W_CALLS, W_ANN)}, cells AS (SELECT run_id, feature_id, codon_pos, ref_aa, alt_aa, max(af) AS af FROM ann WHERE consequence <> 'synonymous' GROUP BY ALL), keys AS (SELECT DISTINCT feature_id, codon_pos, ref_aa, alt_aa FROM cells), runs AS (SELECT DISTINCT run_id FROM ann) SELECT r.run_id, k.*, CASE WHEN c.af IS NOT NULL THEN c.af WHEN b.run_id IS NOT NULL THEN NULL ELSE 0.0 END AS cell FROM keys k CROSS JOIN runs r LEFT JOIN cells c ON c.run_id = r.run_id AND c.feature_id = k.feature_id AND c.codon_pos = k.codon_pos AND c.ref_aa = k.ref_aa AND c.alt_aa = k.alt_aa LEFT JOIN bare b ON b.run_id = r.run_id AND b.feature_id = k.feature_id AND b.codon_pos = k.codon_pos")
def m1_mutation_matrix(spark, d):
    ann = annotations(spark, d)
    return compare.mutation_matrix(ann, ann.select("run_id").distinct(), gaps(spark, d), non_synonymous_only=True)


KB = f"kb AS ({fixtures.oracle('kbs')})"
W_SETS = f"{KB}, sets AS (SELECT gene, position, drug, string_agg(DISTINCT db, '+' ORDER BY db) AS region, count(DISTINCT db) AS dbs FROM kb GROUP BY ALL)"
KEYS = ["gene", "position", "drug"]


@query(f"WITH {KB} SELECT accession FROM kb GROUP BY accession HAVING count(DISTINCT db) = 3")
def j19_shared_references(spark, d):
    return compare.shared_references(fixture(spark, d, "kbs"), 3)


@query(f"""WITH {KB}, p AS (SELECT gene, position, drug, db, phenotype AS v, min(rule_id) AS first_at FROM kb GROUP BY ALL), s AS (SELECT gene, position, drug, db, score AS v, min(rule_id) AS first_at FROM kb WHERE trim(score) <> '' GROUP BY ALL),
 e AS (SELECT DISTINCT gene, position, drug, db FROM kb), pl AS (SELECT gene, position, drug, db, string_agg(v, '; ' ORDER BY first_at, v) AS phenotype FROM p GROUP BY ALL), sl AS (SELECT gene, position, drug, db, string_agg(v, '; ' ORDER BY first_at, v) AS score FROM s GROUP BY ALL)
 SELECT e.*, coalesce(phenotype, '') AS phenotype, coalesce(score, '') AS score FROM e LEFT JOIN pl USING (gene, position, drug, db) LEFT JOIN sl USING (gene, position, drug, db)""")
def a20_compare_rules(spark, d):
    return compare.compare_rules(fixture(spark, d, "kbs"), KEYS, ("phenotype", "score"))


@query(f"WITH {W_SETS} SELECT region, count(*) AS n FROM sets GROUP BY region")
def a21_venn(spark, d):
    return compare.venn(fixture(spark, d, "kbs"), KEYS)


@query(f"WITH {W_SETS}, w(subset) AS (VALUES ('A'), ('B'), ('C'), ('A+B'), ('A+C'), ('B+C'), ('A+B+C')) SELECT subset, CAST(count(*) AS BIGINT) AS n FROM w JOIN sets ON list_has_all(string_split(region, '+'), string_split(subset, '+')) GROUP BY subset")
def a21b_venn_inclusive(spark, d):
    return compare.venn_inclusive(compare.venn(fixture(spark, d, "kbs"), KEYS), ["A", "B", "C"])


@query(f"WITH {W_SETS} SELECT count(*) AS total_unique, count(*) FILTER (dbs = 3) AS intersection FROM sets")
def a22_compare_counts(spark, d):
    return compare.compare_counts(fixture(spark, d, "kbs"), KEYS, 3)


@query(f"SELECT DISTINCT * FROM ({fixtures.oracle('matches')}) QUALIFY row_number() OVER (PARTITION BY run_id, query ORDER BY identity DESC, cds_coverage DESC, query_coverage DESC, feature) = 1")
def w1_best_reference(spark, d):
    return tables.best_reference(fixture(spark, d, "matches"))


@query(f"WITH {W_HITS}, a AS (SELECT run_id, count(*) AS variants, count(*) FILTER (consequence <> 'synonymous') AS non_synonymous FROM ann GROUP BY ALL), h AS (SELECT run_id, count(*) AS hits, count(DISTINCT (feature_id, codon_pos, alt_aa)) AS mutations_hit FROM hits GROUP BY ALL) SELECT a.*, coalesce(hits, 0) AS hits, coalesce(mutations_hit, 0) AS mutations_hit FROM a LEFT JOIN h USING (run_id)")
def a16_run_summary(spark, d):
    return tables.run_summary(annotations(spark, d), hits(spark, d))


@query(f"WITH {W_ANN}, m AS (SELECT DISTINCT run_id, feature_id, codon_pos, ref_aa || CAST(codon_pos + 1 AS VARCHAR) || alt_aa AS label FROM ann WHERE consequence <> 'synonymous') SELECT run_id, feature_id, CAST(count(*) AS INT) AS n, string_agg(label, ',' ORDER BY codon_pos, label) AS labels FROM m GROUP BY ALL")
def a15_mutation_profile(spark, d):
    return tables.mutation_profile(annotations(spark, d))


@query(f"SELECT drug, count(*) AS n FROM ({fixtures.oracle('rules')}) GROUP BY drug")
def a23_rules_per_drug(spark, d):
    return tables.kb_breakdown(fixture(spark, d, "rules"), "drug")


@query(f"WITH r AS ({fixtures.oracle('rules')}) SELECT CAST(t.i AS INT) AS bin, count(DISTINCT (feature_id, position, mutation)) FILTER (r.position IS NOT NULL) AS n FROM range(20) t(i) LEFT JOIN r ON CAST(floor(position / 10) AS INT) = t.i GROUP BY t.i")
def a24_position_histogram(spark, d):
    return tables.position_histogram(fixture(spark, d, "rules"), fixture(spark, d, "feature"))


@query("WITH t AS (SELECT p_type, sum(p_size) AS n FROM part GROUP BY p_type), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, p_type) AS k FROM t) SELECT CASE WHEN k <= 6 THEN p_type ELSE 'Other' END AS p_type, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def o3_top_n_other(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet").select("p_type", F.col("p_size").cast("long").alias("n"))
    return tables.top_n_other(x, "p_type", "n")


@query("SELECT p_partkey, p_brand || CASE WHEN row_number() OVER w > 1 THEN '_' || row_number() OVER w ELSE '' END AS p_brand FROM part WINDOW w AS (PARTITION BY p_size, p_brand ORDER BY p_partkey)")
def w11_unique_names(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet")
    return tables.unique_names(x, "p_brand", ["p_size"], "p_partkey").select("p_partkey", "p_brand")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def w12_latest(spark, d):
    return tables.latest(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderdate")


@query("SELECT * FROM part WHERE p_size IN (1, 2, 3) AND contains(lower(p_name), 'a')")
def p9_facet_filter(spark, d):
    return tables.facet_filter(spark.read.parquet(f"{d}/part.parquet"), {"p_size": [1, 2, 3], "p_brand": []}, "A", "p_name")


@query("SELECT DISTINCT p_brand FROM part WHERE p_size IN (1, 2)")
def p9b_facet_options(spark, d):
    return tables.facet_options(spark.read.parquet(f"{d}/part.parquet"), {"p_size": [1, 2], "p_brand": ["x"]}, "p_brand")


@query(f"SELECT rule_id, {RANK} AS rank FROM ({fixtures.oracle('rules')})")
def f20_label_to_rank(spark, d):
    return fixture(spark, d, "rules").select("rule_id", S.label_to_rank(F.col("phenotype")).alias("rank"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN f BETWEEN 0.75 AND 1 THEN 'high' WHEN f BETWEEN 0.25 AND 0.7499 THEN 'intermediate' WHEN f BETWEEN 0.01 AND 0.2499 THEN 'low' ELSE '' END AS af_bin FROM (SELECT *, round(l_discount * 10, 2) AS f FROM lineitem)")
def f19_af_bin(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet")
    return x.select("l_orderkey", "l_linenumber", S.af_bin(F.round(F.col("l_discount") * 10, 2)).alias("af_bin"))


@query("SELECT event_id, reverse(translate(upper(event_type), 'ACGTRYKMBVDHN', 'TGCAYRMKVBHDN')) AS rc FROM events")
def f3_reverse_complement(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.reverse_complement(F.col("event_type")).alias("rc"))


@query("SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS n FROM events GROUP BY ALL")
def r2_submissions_per_minute(spark, d):
    x = submissions_per_minute(spark.read.parquet(f"{d}/events.parquet"))
    return x.withColumn("minute", F.col("minute").cast("timestamp_ntz"))
