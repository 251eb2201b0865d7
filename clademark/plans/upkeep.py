"""Registered queries of liftover to the genome and of upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import liftover, upkeep
from . import fixtures
from .catalog import ORACLE, QUERIES, W_ANN, W_HITS, _B, annotations, hits, query
from .fixtures import fixture
from .formulas import _RUNS, W_EVAL, _compiled

__all__ = ["ORACLE", "QUERIES"]

_OWN = "CASE WHEN feature_id % 3 = 0 THEN '-' ELSE '+' END"
_REL = lambda p: f"CASE WHEN strand = '-' THEN query_end - 1 - ({p}) ELSE ({p}) - query_start END"
_CDS = lambda r: f"CASE WHEN {r} < 0 OR {r} >= 450 + ins THEN NULL WHEN {r} < 100 THEN {r} WHEN {r} >= 300 + ins THEN {r} - ins + del WHEN {r} >= 100 + ins THEN {r} - ins END"
_COMP = lambda s: f"translate({s}, 'ACGT', 'TGCA')"


@query(f"""WITH c AS ({fixtures.oracle('indel_calls')}), m AS ({fixtures.oracle('alignments')}), j AS (SELECT c.run_id, c.chrom, c.pos, c.ref, c.alt, feature_id, strand, ins, del, {_OWN} AS own, {_REL('pos')} AS r0, {_REL('pos + length(ref) - 1')} AS r1 FROM c JOIN m ON c.chrom = m.chrom AND pos >= query_start AND pos < query_end),
 k AS (SELECT *, {_CDS('r0')} AS c0, {_CDS('r1')} AS c1, strand <> own AS turned, length(ref) <> 1 OR length(alt) <> 1 AS sized FROM j),
 l AS (SELECT *, CAST(CASE WHEN c0 IS NULL THEN NULL WHEN turned AND sized THEN CASE WHEN c1 + CASE WHEN own = '-' THEN 1 ELSE -1 END >= 0 THEN c1 + CASE WHEN own = '-' THEN 1 ELSE -1 END END ELSE c0 END AS INT) AS cds_pos FROM k),
 g AS (SELECT *, CASE WHEN cds_pos < 600 THEN CASE WHEN own = '-' THEN feature_id * 1000 + 599 - cds_pos ELSE feature_id * 1000 + cds_pos END END AS g_pos, CASE WHEN own = '-' THEN {_COMP(_B('cds_pos'))} ELSE {_B('cds_pos')} END AS base FROM l),
 o AS (SELECT *, CASE WHEN cds_pos IS NULL THEN 'no match' WHEN g_pos IS NULL THEN 'not coding' END AS reason FROM g)
 SELECT run_id, chrom, pos, ref, alt, feature_id, cds_pos, CAST(g_pos AS BIGINT) AS g_pos, reason,
  CASE WHEN reason IS NULL THEN CASE WHEN turned AND sized THEN CASE WHEN length(alt) > length(ref) THEN base ELSE base || reverse({_COMP('substr(ref, 2)')}) END WHEN turned THEN {_COMP('substr(ref, 1, 1)')} || reverse({_COMP('substr(ref, 2)')}) ELSE ref END END AS g_ref,
  CASE WHEN reason IS NULL THEN CASE WHEN turned AND sized THEN CASE WHEN length(alt) > length(ref) THEN base || reverse({_COMP('substr(alt, 2)')}) ELSE base END WHEN turned THEN {_COMP('substr(alt, 1, 1)')} || reverse({_COMP('substr(alt, 2)')}) ELSE alt END END AS g_alt FROM o""")
def j2_project_calls(spark, d):
    at = F.col("feature_id") * 1000
    own = F.when(F.col("feature_id") % 3 == 0, "-").otherwise("+")
    f = fixtures.features(spark, d).select("feature_id", own.alias("strand"), "nt_sequence", F.array(F.struct(at.alias("start"), (at + 600).alias("end"))).alias("segments"))
    x = liftover.project_calls(fixture(spark, d, "indel_calls"), fixture(spark, d, "alignments").drop("ins", "del"), f)
    return x.select("run_id", "chrom", "pos", "ref", "alt", "feature_id", "cds_pos", "g_pos", "reason", "g_ref", "g_alt")


W_MEMO = "q AS (SELECT o_orderkey AS run_id, o_orderpriority || CAST(o_custkey % 9 AS VARCHAR) AS sequence FROM orders), memo AS (SELECT DISTINCT sha256(upper(o_orderpriority || CAST(o_custkey % 9 AS VARCHAR))) AS checksum, o_orderpriority AS feature FROM orders WHERE o_custkey % 9 < 5)"


@query(f"WITH {W_MEMO} SELECT feature, count(*) AS n FROM q LEFT JOIN memo ON sha256(upper(sequence)) = checksum GROUP BY feature")
def s16_cached_matches(spark, d):
    seq = F.concat("o_orderpriority", (F.col("o_custkey") % 9).cast("string"))
    o = spark.read.parquet(f"{d}/orders.parquet")
    memo = o.filter("o_custkey % 9 < 5").select(F.sha2(F.upper(seq), 256).alias("checksum"), F.col("o_orderpriority").alias("feature")).distinct()
    known, rest = upkeep.with_cached_matches(o.select(F.col("o_orderkey").alias("run_id"), F.lit("q").alias("query"), F.lower(seq).alias("sequence")), memo)
    return known.select("feature").unionByName(rest.select(F.lit(None).cast("string").alias("feature"))).groupBy("feature").agg(F.count("*").alias("n"))


W_PUBS = f"""p AS ({fixtures.oracle('pubs')}), cr AS (SELECT '10.1/' || CAST(p_partkey % 25 AS VARCHAR) AS doi, min(p_name) AS title, CAST(min(p_size) AS INT) AS year FROM part GROUP BY 1),
 pm AS (SELECT CAST(s_suppkey AS VARCHAR) AS pmid, CASE WHEN s_suppkey % 4 = 0 THEN '10.1/' || CAST(s_suppkey % 30 AS VARCHAR) ELSE '' END AS doi, s_name AS title, s_nationkey AS year FROM supplier)"""


@query(f"""WITH {W_PUBS}, a AS (SELECT p.publication_id, coalesce(nullif(p.doi, ''), nullif(pm.doi, ''), '') AS doi, p.pmid, pm.title AS t2, pm.year AS y2 FROM p LEFT JOIN pm ON p.pmid = pm.pmid),
 b AS (SELECT doi, min({{'pmid': pmid, 'title': title, 'year': year}}) AS n FROM pm WHERE doi <> '' GROUP BY doi), c AS (SELECT a.*, n, cr.title AS t1, cr.year AS y1 FROM a LEFT JOIN b ON a.doi = b.doi LEFT JOIN cr ON a.doi = cr.doi)
 SELECT publication_id, doi, coalesce(pmid, n.pmid, '') AS pmid, coalesce(t1, t2, n.title, '') AS title, CAST(coalesce(y1, y2, n.year) AS INT) AS year FROM c""")
def s17_enrich_publications(spark, d):
    part, sup = spark.read.parquet(f"{d}/part.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    cr = part.groupBy(F.concat(F.lit("10.1/"), (F.col("p_partkey") % 25).cast("string")).alias("doi")).agg(F.min("p_name").alias("title"), F.min("p_size").cast("int").alias("year"))
    pm = sup.select(F.col("s_suppkey").cast("string").alias("pmid"), F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("10.1/"), (F.col("s_suppkey") % 30).cast("string"))).otherwise("").alias("doi"), F.col("s_name").alias("title"), F.col("s_nationkey").cast("int").alias("year"))
    return upkeep.enrich_publications(fixture(spark, d, "pubs"), cr, pm)


@query("""WITH a AS (SELECT s_name AS name, s_nationkey AS length, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'old' END AS note FROM supplier WHERE s_suppkey % 3 <> 0), b AS (SELECT s_name AS name, s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS length, 'new' AS note FROM supplier WHERE s_suppkey % 4 <> 0)
 SELECT coalesce(a.name, b.name) AS name, coalesce(a.length, b.length) AS length, CASE WHEN a.name IS NULL THEN 'new' WHEN a.note <> '' THEN a.note WHEN b.name IS NOT NULL AND a.length = b.length THEN 'new' ELSE '' END AS note, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NOT NULL AND a.length <> b.length THEN 'conflict' ELSE 'stored' END AS status FROM a FULL JOIN b ON a.name = b.name""")
def t1_extend_features(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet")
    a = s.filter("s_suppkey % 3 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("length"), F.when(F.col("s_suppkey") % 2 == 0, " ").otherwise("old").alias("note"))
    b = s.filter("s_suppkey % 4 <> 0").select(F.col("s_name").alias("name"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).alias("length"), F.lit("new").alias("note"))
    return upkeep.extend_features(a, b, ["length"], ["note"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS n, s_nationkey AS first_start FROM supplier")
def t5_backfill_segments(spark, d):
    at = F.col("s_nationkey").cast("long")
    two = F.array(F.struct(at.alias("start"), (at + 5).alias("end")), F.struct((at + 9).alias("start"), (at + 20).alias("end")))
    x = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", at.alias("start"), (at + 20).alias("end"), F.when(F.col("s_suppkey") % 3 == 0, two).alias("segments"))
    return upkeep.backfill_segments(x).select("s_suppkey", F.size("segments").alias("n"), F.get("segments", F.lit(0))["start"].alias("first_start"))


W_ID = W_ANN + ", a AS (SELECT *, (feature_id * 200 + codon_pos) * 1000 + CAST(round(af * 100) AS BIGINT) AS ann_id FROM ann), h AS (SELECT run_id, feature_id, codon_pos, ref_aa, CASE WHEN codon_pos % 7 = 0 THEN '?' ELSE alt_aa END AS alt_aa, CASE WHEN codon_pos % 3 = 0 THEN af + 0.05 ELSE af END AS af FROM ann WHERE consequence = 'missense')"


@query(f"WITH {W_ID}, s AS (SELECT run_id, feature_id, codon_pos, ref_aa, alt_aa, round(af, 6) AS k, min(ann_id) AS s FROM a GROUP BY ALL), w AS (SELECT run_id, feature_id, codon_pos, ref_aa, alt_aa, min(ann_id) AS w FROM a GROUP BY ALL) SELECT h.run_id, h.feature_id, h.codon_pos, h.alt_aa, round(h.af, 6) AS af, coalesce(s, w) AS ann_id, CASE WHEN s IS NOT NULL THEN 'exact' WHEN w IS NOT NULL THEN 'place' ELSE 'none' END AS found FROM h LEFT JOIN s ON h.run_id = s.run_id AND h.feature_id = s.feature_id AND h.codon_pos = s.codon_pos AND h.ref_aa = s.ref_aa AND h.alt_aa = s.alt_aa AND round(h.af, 6) = k LEFT JOIN w ON h.run_id = w.run_id AND h.feature_id = w.feature_id AND h.codon_pos = w.codon_pos AND h.ref_aa = w.ref_aa AND h.alt_aa = w.alt_aa")
def j12_reattach_evidence(spark, d):
    ann = annotations(spark, d)
    ids = ann.withColumn("ann_id", (F.col("feature_id") * 200 + F.col("codon_pos")) * 1000 + F.round(F.col("af") * 100).cast("long"))
    h = ann.filter("consequence = 'missense'").select("run_id", "feature_id", "codon_pos", "ref_aa", F.when(F.col("codon_pos") % 7 == 0, "?").otherwise(F.col("alt_aa")).alias("alt_aa"), F.when(F.col("codon_pos") % 3 == 0, F.col("af") + 0.05).otherwise(F.col("af")).alias("af"))
    x = upkeep.reattach_evidence(h, ids)
    return x.select("run_id", "feature_id", "codon_pos", "alt_aa", F.round("af", 6).alias("af"), "ann_id", "found")


W_RUNS = "r AS (SELECT DISTINCT run_id, run_id % 6 AS project_id, CASE WHEN run_id % 4 = 0 THEN '' WHEN run_id % 4 = 1 THEN 'old' ELSE 'u' || CAST(run_id % 6 AS VARCHAR) END AS u FROM ann), pr AS (SELECT DISTINCT s_suppkey % 5 AS project_id, 'u' || CAST(s_suppkey % 5 AS VARCHAR) AS uuid FROM supplier)"


def _kept(spark, d):
    ann = annotations(spark, d)
    k = F.col("run_id") % 4
    runs = ann.select("run_id").distinct().withColumns({"project_id": F.col("run_id") % 6, "project_uuid": F.when(k == 0, "").when(k == 1, "old").otherwise(F.concat(F.lit("u"), (F.col("run_id") % 6).cast("string")))})
    pr = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") % 5).alias("project_id")).distinct().withColumn("uuid", F.concat(F.lit("u"), F.col("project_id").cast("string")))
    return runs, ann, pr


def _resync(spark, d):
    runs, ann, pr = _kept(spark, d)
    return upkeep.resync(runs, ann, pr, fixture(spark, d, "rules"))


@query(f"WITH {W_HITS}, {W_RUNS} SELECT h.run_id, h.rule_id, h.feature_id, h.codon_pos, h.af FROM hits h JOIN r USING (run_id) JOIN pr USING (project_id) WHERE u = '' OR u = uuid")
def t6_resync_hits(spark, d):
    return _resync(spark, d)[0].select("run_id", "rule_id", "feature_id", "codon_pos", "af")


@query(f"WITH {W_ANN}, {W_RUNS} SELECT run_id, CASE WHEN uuid IS NULL THEN 'unknown project' ELSE 'other knowledge base' END AS reason FROM r LEFT JOIN pr USING (project_id) WHERE uuid IS NULL OR (u <> '' AND u <> uuid)")
def t6_resync_skipped(spark, d):
    return _resync(spark, d)[1].select("run_id", "reason")


W_RENEWED = W_EVAL.replace(_RUNS, f"{W_RUNS}, runs AS (SELECT run_id, project_id FROM r JOIN pr USING (project_id) WHERE u = '' OR u = uuid)")


@query(f"""WITH {W_RENEWED}, effects AS ({fixtures.oracle('effects')}), n1 AS (SELECT run_id, count(*) AS n FROM hits GROUP BY run_id), n2 AS (SELECT run_id, count(*) AS n FROM fired GROUP BY run_id),
 n3 AS (SELECT run_id, count(*) AS n FROM ann a JOIN effects x ON a.feature_id = x.feature_id AND a.consequence = x.effect GROUP BY run_id)
 SELECT runs.run_id, coalesce(n1.n, 0) AS resistance_hits, coalesce(n2.n, 0) AS formula_hits, coalesce(n3.n, 0) AS effect_hits FROM runs LEFT JOIN n1 USING (run_id) LEFT JOIN n2 USING (run_id) LEFT JOIN n3 USING (run_id)""")
def t6_resync_all(spark, d):
    """What rules, formulas and effects as they are now say of the runs that are renewed."""
    runs, ann, pr = _kept(spark, d)
    named = fixture(spark, d, "rules").withColumn("member_id", F.concat(F.lit("r"), F.col("rule_id").cast("string")))
    effects = fixture(spark, d, "effects").groupBy("feature_id", "drug").agg(F.collect_list("effect").alias("effects"))
    return upkeep.resync_all(runs, ann, pr, named, _compiled(spark, d), effects, eps=1e-6)["counts"]


@query(f"WITH {W_HITS} SELECT run_id, feature_id * 1000 + codon_pos AS ann_id, rule_id, drug, phenotype, count(*) AS n FROM hits GROUP BY ALL")
def t7_rebuild_hits(spark, d):
    h = hits(spark, d).withColumn("ann_id", F.col("feature_id") * 1000 + F.col("codon_pos"))
    stored = h.groupBy("run_id", "ann_id").agg(F.to_json(F.collect_list(F.struct("rule_id", "drug", "phenotype"))).alias("drug_hits"))
    return upkeep.rebuild_hits(stored).groupBy("run_id", "ann_id", "rule_id", "drug", "phenotype").agg(F.count("*").alias("n"))
