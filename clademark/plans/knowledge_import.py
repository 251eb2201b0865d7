"""Registered queries of the import of rules and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kb_import, rule_files
from . import fixtures
from .catalog import ORACLE, QUERIES, query
from .fixtures import fixture

__all__ = ["ORACLE", "QUERIES"]

W_KF = f"kf AS ({fixtures.oracle('kb_features')}), raw AS ({fixtures.oracle('raw_rules')})"


def _raw(spark, d):
    return fixture(spark, d, "raw_rules")


@query(f"""WITH {W_KF}, x AS (SELECT *, regexp_extract(upper(mutation), '^([A-Z*]+)([0-9]+)([A-Z*]+)$', ['l', 'p', 'r']) AS g FROM raw),
 y AS (SELECT *, g.l AS l, g.p AS p, g.r AS r, substr(g.l, 2) AS lt, substr(g.r, 2) AS rt FROM x),
 z AS (SELECT *, coalesce(p <> '' AND TRY_CAST(p AS BIGINT) = TRY_CAST(position AS BIGINT) AND (reference = '' OR upper(reference) IN (l, substr(l, 1, 1))) AND NOT regexp_matches(upper(mutation), 'DEL$|INS|FRAMESHIFT|STOP') AND NOT regexp_matches(r, '^(DEL|INS|FS|STOP)')
  AND substr(l, 1, 1) <> substr(r, 1, 1) AND ((starts_with(rt, lt) AND length(rt) > length(lt)) OR (starts_with(lt, rt) AND length(lt) > length(rt))), FALSE) AS mixed, CASE WHEN member_id <> '' THEN member_id ELSE '__auto_anchor_split_row_' || CAST(row_no AS VARCHAR) END AS name FROM y)
 SELECT row_no, reference, mutation, member_id FROM z WHERE NOT mixed UNION ALL SELECT row_no, substr(l, 1, 1), substr(r, 1, 1), name || '__sub' FROM z WHERE mixed UNION ALL SELECT row_no, l, substr(l, 1, 1) || rt, name || '__indel' FROM z WHERE mixed""")
def f10_split_anchor_changed(spark, d):
    return kb_import.split_anchor_changed(_raw(spark, d)).select("row_no", "reference", "mutation", "member_id")


W_FEAT = W_KF + """, al AS (SELECT feature_id, aa_sequence, reference_name, accession, name AS key, 0 AS rank FROM kf UNION ALL SELECT feature_id, aa_sequence, reference_name, accession, locus_tag, 1 FROM kf UNION ALL SELECT feature_id, aa_sequence, reference_name, accession, protein_id, 2 FROM kf UNION ALL SELECT feature_id, aa_sequence, reference_name, accession, protein, 3 FROM kf),
 cand AS (SELECT row_no, feature_id, aa_sequence, rank, reference_identifier, reference_name, accession FROM raw JOIN al ON trim(raw.feature) = al.key WHERE al.key <> ''),
 own AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY row_no) AS least FROM cand) WHERE reference_identifier = '' OR reference_identifier = reference_name OR reference_identifier = accession), best AS (SELECT row_no, count(DISTINCT feature_id) AS n, min(feature_id) AS fid, arg_min(aa_sequence, feature_id) AS seq FROM own WHERE least > 0 OR rank = 0 GROUP BY row_no),
 res AS (SELECT raw.*, CASE WHEN n = 1 THEN fid END AS feature_id, CASE WHEN n = 1 THEN seq END AS aa_sequence, CASE WHEN n IS NULL THEN 'unknown feature' WHEN n > 1 THEN 'ambiguous feature' END AS problem FROM raw LEFT JOIN best USING (row_no))"""


@query(f"WITH {W_FEAT} SELECT row_no, feature_id, problem FROM res")
def j9_resolve_rule_feature(spark, d):
    return kb_import.resolve_rule_feature(_raw(spark, d), fixture(spark, d, "kb_features")).select("row_no", "feature_id", "problem")


W_BASE = W_FEAT + """, ver AS (SELECT *, TRY_CAST(position AS INT) AS p FROM res WHERE reference <> '' AND TRY_CAST(position AS INT) IS NOT NULL AND length(aa_sequence) > 0),
 cnt AS (SELECT file, count(*) AS checked, count(*) FILTER (p >= 1 AND substr(aa_sequence, p, 1) = upper(substr(reference, 1, 1))) AS from_1, count(*) FILTER (p >= 0 AND substr(aa_sequence, p + 1, 1) = upper(substr(reference, 1, 1))) AS from_0 FROM ver GROUP BY file),
 base AS (SELECT file, coalesce(checked, 0) AS checked, coalesce(from_1, 0) AS from_1, coalesce(from_0, 0) AS from_0, CASE WHEN checked IS NULL THEN 1 WHEN from_0 > from_1 THEN 0 WHEN from_1 > 0 THEN 1 END AS base FROM (SELECT DISTINCT file FROM raw) LEFT JOIN cnt USING (file)),
 val AS (SELECT v.row_no, CASE WHEN p - base < 0 OR p - base + length(reference) > length(aa_sequence) THEN 'out of range' WHEN substr(aa_sequence, p - base + 1, length(reference)) <> upper(reference) THEN 'reference mismatch' END AS skip FROM ver v JOIN base USING (file))"""


def _resolved(spark, d):
    return kb_import.resolve_rule_feature(_raw(spark, d), fixture(spark, d, "kb_features"))


@query(f"WITH {W_BASE} SELECT * FROM base")
def a17_detect_coordinate_base(spark, d):
    return kb_import.detect_coordinate_base(_resolved(spark, d))


@query(f"WITH {W_BASE} SELECT row_no, skip FROM raw LEFT JOIN val USING (row_no)")
def a18_validate_reference_aa(spark, d):
    x = _resolved(spark, d)
    return kb_import.validate_reference_aa(x, kb_import.detect_coordinate_base(x)).select("row_no", "skip")


@query(f"""WITH {W_KF}, x AS (SELECT row_no, reference AS ref, mutation AS m, upper(mutation) AS u, CAST(position AS INT) - 1 AS p, kind FROM raw),
 y AS (SELECT *, CASE kind WHEN 2 THEN ref || 'fsX' WHEN 3 THEN '*' WHEN 4 THEN 'INS_any' WHEN 5 THEN ref || 'GG' WHEN 6 THEN ref || 'GG' WHEN 7 THEN substr(m, 1, length(m) - length(CAST(p + 1 AS VARCHAR)) - 1) WHEN 8 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL WHEN 13 THEN NULL ELSE u END AS t FROM x)
 SELECT row_no, CASE WHEN kind = 7 THEN ref ELSE CASE WHEN kind IN (0, 1, 9) THEN u ELSE t END END AS mutation, CASE WHEN ref = '' OR m = '' THEN 'blank' WHEN kind IN (8, 11, 12) THEN 'unrecognised' WHEN kind = 6 THEN 'position conflict' WHEN kind IN (0, 1, 9) AND ref = u THEN 'no change' WHEN kind = 9 AND u = 'B' THEN 'unsupported' END AS problem FROM y""")
def f9_rule_alleles(spark, d):
    x = _raw(spark, d).withColumn("a", kb_import.rule_alleles(F.col("reference"), F.col("mutation"), F.col("position").cast("int") - 1))
    return x.select("row_no", "a.mutation", "a.problem")


@query("WITH x AS (SELECT p_partkey, p_size % 12 AS pos, substr('ACDEFGHIKLMNPQRSTVWY', CAST(p_size % 12 AS INT) + 1, CAST(1 + p_partkey % 3 AS INT)) AS block, substr('ACDEFGHIKLMNPQRSTVWY', 1, CAST(12 + p_partkey % 2 AS INT)) AS seq FROM part), y AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'W' || substr(block, 2) ELSE block END AS b FROM x) SELECT p_partkey, CASE WHEN pos >= 1 AND pos + length(b) <= length(seq) AND substr(seq, CAST(pos AS INT) + 1, length(b)) = b THEN substr(seq, CAST(pos AS INT), 1) || b || CAST(pos AS VARCHAR) || substr(seq, CAST(pos AS INT), 1) END AS mutation FROM y")
def f11_anchorless_deletion(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet")
    pos, seq = (F.col("p_size") % 12).cast("int"), F.substring(F.lit(kb_import.RESIDUES), F.lit(1), (F.col("p_partkey") % 2 + 12).cast("int"))
    block = F.substring(F.lit(kb_import.RESIDUES), pos + 1, (F.col("p_partkey") % 3 + 1).cast("int"))
    block = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("W"), F.substring(block, 2, 9))).otherwise(block)
    return x.select("p_partkey", kb_import.resolve_anchorless_deletion(block, pos, seq)["mutation"].alias("mutation"))


@query(f"WITH {W_KF}, x AS (SELECT *, row_number() OVER w AS n, first_value(reference || mutation) OVER w = reference || mutation AS same FROM raw WINDOW w AS (PARTITION BY CASE WHEN member_id = '' THEN CAST(row_no AS VARCHAR) ELSE 'm' || member_id END ORDER BY row_no)) SELECT row_no, CASE WHEN n > 1 AND same THEN '' ELSE member_id END AS member_id, CASE WHEN n > 1 AND same THEN 'stripped' WHEN n > 1 THEN 'conflict' END AS repeat FROM x")
def w4_first_definition(spark, d):
    return kb_import.first_definition(_raw(spark, d), ["reference", "mutation"]).select("row_no", "member_id", "repeat")


@query("""WITH f AS (SELECT p_partkey AS row_no, CASE WHEN p_partkey % 2 = 0 THEN 'Drug' ELSE 'drug' END || CAST(p_size % 5 AS VARCHAR) AS drug, 'f' || CAST(p_partkey % 150 AS VARCHAR) AS formula_id, substr(p_brand, 1, 8) AS canonical FROM part),
 t AS (SELECT *, row_number() OVER (PARTITION BY lower(drug), canonical ORDER BY row_no) AS t FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY formula_id ORDER BY row_no) AS i FROM t WHERE t = 1)
 SELECT row_no, 'formula' AS repeat FROM t WHERE t > 1 UNION ALL SELECT row_no, CASE WHEN i > 1 THEN 'id' END FROM k""")
def w4b_dedupe_formulas(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet")
    drug = F.concat(F.when(F.col("p_partkey") % 2 == 0, "Drug").otherwise("drug"), (F.col("p_size") % 5).cast("string"))
    f = x.select(F.col("p_partkey").alias("row_no"), drug.alias("drug"), F.concat(F.lit("f"), (F.col("p_partkey") % 150).cast("string")).alias("formula_id"), F.substring("p_brand", 1, 8).alias("canonical"))
    return kb_import.dedupe_formulas(f).select("row_no", "repeat")


@query(f"WITH k AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN p_name || '.' WHEN 3 THEN 'publications have contradictory phenotype associations.' ELSE p_name END AS c, CASE WHEN p_size % 3 = 0 THEN 'contradictory' ELSE 'resistant' END AS ph FROM part) SELECT p_partkey, CASE WHEN ph <> 'contradictory' THEN c WHEN p_partkey % 5 = 0 THEN '{kb_import.CONTRADICTORY}' WHEN p_partkey % 5 = 3 THEN c WHEN p_partkey % 5 = 2 THEN c || ' {kb_import.CONTRADICTORY}' ELSE c || '. {kb_import.CONTRADICTORY}' END AS comment FROM k")
def f25_contradictory_comment(spark, d):
    x = spark.read.parquet(f"{d}/part.parquet")
    kind = F.col("p_partkey") % 5
    c = F.when(kind == 0, "").when(kind == 2, F.concat("p_name", F.lit("."))).when(kind == 3, kb_import.CONTRADICTORY.replace("P", "p", 1)).otherwise(F.col("p_name"))
    label = F.when(F.col("p_size") % 3 == 0, "contradictory").otherwise("resistant")
    return x.select("p_partkey", kb_import.contradictory_comment(c, label, F.lit("")).alias("comment"))


@query(f"WITH {W_KF}, s AS (SELECT DISTINCT feature, position, mutation FROM raw WHERE row_no % 4 = 0), n AS (SELECT r.* FROM raw r ANTI JOIN s USING (feature, position, mutation) WHERE member_id = '' QUALIFY row_number() OVER (PARTITION BY feature, position, mutation ORDER BY row_no) = 1) SELECT row_no FROM n UNION ALL SELECT row_no FROM raw WHERE member_id <> ''")
def j10_new_rules_only(spark, d):
    x = _raw(spark, d)
    return kb_import.new_rules_only(x, x.filter("row_no % 4 = 0"), ["feature", "position", "mutation"]).select("row_no")


# Rows as files have them: all with a reference (of the feature's, if it is none that is known), every tenth without a drug, some with odd values.
RULE_FILE = """SELECT CAST(row_no AS BIGINT) AS row_no, 'f' || CAST(file AS VARCHAR(9)) AS file, kind, trim(feature) AS feature, CASE WHEN row_no % 11 = 0 THEN '' WHEN row_no % 13 = 0 THEN 'other' WHEN reference_identifier = '' THEN 'ref' || CAST(row_no % 4 AS VARCHAR(9)) ELSE reference_identifier END AS reference_identifier, reference, position, mutation,
 CASE WHEN row_no % 17 = 0 THEN '' ELSE 'drug' || CAST(row_no % 3 AS VARCHAR(9)) END AS antiviral, member_id, CASE row_no % 6 WHEN 0 THEN ' Resistant' WHEN 1 THEN '4' WHEN 2 THEN 'contradictory' WHEN 3 THEN 'none' WHEN 4 THEN '' ELSE 'HRI' END AS phenotype, CASE WHEN row_no % 19 = 0 THEN 'odd' ELSE '> ' || CAST(row_no % 50 AS VARCHAR(9)) END AS ic50, CASE WHEN row_no % 23 = 0 THEN '1 2' ELSE CAST(row_no % 7 AS VARCHAR(9)) END AS score FROM {raw}"""
W_FILE = f"""{W_KF}, rf AS ({RULE_FILE.format(raw="raw")}),
 mix AS (SELECT *, upper(mutation) AS u, regexp_extract(upper(mutation), '^([A-Z*]+)([0-9]+)([A-Z*]+)$', ['l', 'p', 'r']) AS g FROM rf),
 mx AS (SELECT *, coalesce(g.p <> '' AND TRY_CAST(g.p AS BIGINT) = TRY_CAST(position AS BIGINT) AND (reference = '' OR reference IN (g.l, substr(g.l, 1, 1))) AND NOT regexp_matches(u, 'DEL$|INS|FRAMESHIFT|STOP') AND NOT regexp_matches(g.r, '^(DEL|INS|FS|STOP)') AND substr(g.l, 1, 1) <> substr(g.r, 1, 1)
  AND ((starts_with(substr(g.r, 2), substr(g.l, 2)) AND length(g.r) > length(g.l)) OR (starts_with(substr(g.l, 2), substr(g.r, 2)) AND length(g.l) > length(g.r))), FALSE) AS mixed, CASE WHEN member_id <> '' THEN member_id ELSE '__auto_anchor_split_row_' || CAST(row_no AS VARCHAR) || '_' || substr(sha1(file), 1, 8) END AS base_id FROM mix),
 r0 AS (SELECT row_no, file, kind, feature, reference_identifier, reference, position, mutation, antiviral, member_id, phenotype, ic50, score, 0 AS part, FALSE AS mixed FROM mx WHERE NOT mixed
  UNION ALL SELECT row_no, file, kind, feature, reference_identifier, substr(g.l, 1, 1), position, substr(g.r, 1, 1), antiviral, base_id || '__sub', phenotype, ic50, score, 0, TRUE FROM mx WHERE mixed
  UNION ALL SELECT row_no, file, kind, feature, reference_identifier, g.l, position, substr(g.l, 1, 1) || substr(g.r, 2), antiviral, base_id || '__indel', phenotype, ic50, score, 1, TRUE FROM mx WHERE mixed),
 al AS (SELECT feature_id, aa_sequence, reference_name, accession, name AS key, 0 AS rank FROM kf UNION ALL SELECT feature_id, aa_sequence, reference_name, accession, locus_tag, 1 FROM kf UNION ALL SELECT feature_id, aa_sequence, reference_name, accession, protein_id, 2 FROM kf),
 c0 AS (SELECT r0.row_no, r0.file, r0.part, r0.reference_identifier, al.*, min(rank) OVER (PARTITION BY r0.row_no, r0.file, r0.part) AS least FROM r0 JOIN al ON r0.feature = al.key),
 c1 AS (SELECT row_no, file, part, count(DISTINCT feature_id) AS n, min(feature_id) AS fid, arg_min(aa_sequence, feature_id) AS seq FROM c0 WHERE (least > 0 OR rank = 0) AND reference_identifier IN ('', reference_name, accession) GROUP BY ALL),
 r1 AS (SELECT r0.*, CASE WHEN n = 1 THEN fid END AS feature_id, CASE WHEN n = 1 THEN seq END AS seq, feature IN (SELECT key FROM al) AS named, reference_identifier IN (SELECT reference_name FROM kf UNION SELECT accession FROM kf) AS placed, CAST(position AS INT) AS p FROM r0 LEFT JOIN c1 USING (row_no, file, part)),
 b AS (SELECT file, count(*) FILTER (p >= 1 AND substr(seq, p, 1) = substr(reference, 1, 1)) AS one, count(*) FILTER (p >= 0 AND substr(seq, p + 1, 1) = substr(reference, 1, 1)) AS zero, count(*) FILTER (reference <> '' AND length(seq) > 0) AS checked FROM r1 GROUP BY file),
 r2 AS (SELECT r1.*, CASE WHEN checked = 0 THEN 1 WHEN zero > one THEN 0 WHEN one > 0 THEN 1 END AS base FROM r1 JOIN b USING (file)),
 r3 AS (SELECT *, p - base AS at0, CASE WHEN reference <> '' AND length(seq) > 0 THEN CASE WHEN p - base < 0 OR p - base + length(reference) > length(seq) THEN 'out of range' WHEN substr(seq, p - base + 1, length(reference)) <> reference THEN 'reference mismatch' END END AS off FROM r2),
 r4 AS (SELECT *, CASE WHEN mixed THEN upper(mutation) ELSE CASE kind WHEN 2 THEN reference || 'fsX' WHEN 3 THEN '*' WHEN 4 THEN 'INS_any' WHEN 5 THEN reference || 'GG' WHEN 6 THEN reference || 'GG' WHEN 7 THEN reference WHEN 8 THEN NULL WHEN 11 THEN NULL WHEN 12 THEN NULL ELSE upper(mutation) END END AS m, CASE WHEN NOT mixed AND kind = 7 THEN reference || 'KW' ELSE reference END AS l FROM r3),
 r5 AS (SELECT *, CASE WHEN reference_identifier = '' THEN 'no reference_identifier' WHEN reference = '' THEN 'no reference' WHEN base IS NULL THEN 'coordinates' WHEN NOT placed THEN 'unknown reference' WHEN NOT named THEN 'unknown feature' WHEN feature_id IS NULL THEN 'feature not of reference'
   WHEN antiviral = '' THEN 'no drug' WHEN mutation = '' THEN 'no position or mutation' WHEN off IS NOT NULL THEN off
   WHEN ic50 = 'odd' THEN 'invalid ic50' WHEN score = '1 2' THEN 'invalid score' WHEN m IS NULL THEN 'unrecognised'
   WHEN NOT mixed AND kind IN (6, 7) AND CAST(regexp_extract(mutation, '[0-9]+') AS INT) <> at0 + 1 OR NOT mixed AND kind = 5 AND CAST(regexp_extract(mutation, '[0-9]+') AS INT) <> at0 + 1 THEN 'position conflict' WHEN upper(l) = upper(m) THEN 'no change' WHEN m = 'B' THEN 'unsupported' END AS stop FROM r4),
 g1 AS (SELECT *, row_number() OVER w AS n, first_value(struct_pack(feature_id, reference_identifier, at0, l, m)) OVER w = struct_pack(feature_id, reference_identifier, at0, l, m) AS same FROM r5 WHERE stop IS NULL WINDOW w AS (PARTITION BY CASE WHEN member_id = '' THEN file || '/' || CAST(row_no AS VARCHAR) || '/' || CAST(part AS VARCHAR) ELSE 'm' || member_id END ORDER BY file, row_no, part)),
 g2 AS (SELECT *, member_id <> '' AND n > 1 AND NOT same AS conflict, member_id = '' OR (n > 1 AND same) AS free FROM g1),
 g3 AS (SELECT *, row_number() OVER (PARTITION BY conflict, feature_id, antiviral, reference_identifier, at0, l, m ORDER BY file, row_no, part) AS again FROM g2)
 SELECT file, CASE WHEN conflict THEN 'error' WHEN free AND again > 1 THEN 'skip' WHEN member_id <> '' AND free THEN 'note' ELSE 'import' END AS severity, CASE WHEN conflict THEN 'id conflict' WHEN free AND again > 1 THEN 'repeated' WHEN member_id <> '' AND free THEN 'id stripped' ELSE '' END AS reason, count(*) AS n FROM g3 GROUP BY ALL
 UNION ALL SELECT file, CASE WHEN stop IN ('unknown reference', 'unknown feature', 'feature not of reference', 'out of range', 'reference mismatch', 'unsupported') THEN 'skip' ELSE 'error' END, stop, count(*) FROM r5 WHERE stop IS NOT NULL GROUP BY ALL"""


@query(f"WITH {W_FILE}")
def t2_import_report(spark, d):
    """A dry run of all steps over the rows of rule files (T-2, A-31)."""
    raw = spark.sql(RULE_FILE.replace("VARCHAR(9)", "STRING").format(raw="{raw}"), raw=_raw(spark, d))
    found = rule_files.checked_rules(raw, fixture(spark, d, "kb_features"))
    return rule_files.report_counts(rule_files.import_report(found)).drop("kind")
