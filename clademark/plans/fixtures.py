"""Domain tables as projections of the given star schema, in SQL that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of the base (A, C, G, T) at a coding position of a feature: a start codon first, a stop codon last.
BASE = "CASE WHEN {i} IN (0, 598, 599) THEN 0 WHEN {i} IN (1, 597) THEN 3 WHEN {i} = 2 THEN 2 ELSE ({i} * 7 + {i} * {i} + {f}) % 4 END"

SQL = {
    "feature": "SELECT s_suppkey AS feature_id, 'chr' || CAST(s_suppkey % 10 AS VARCHAR(9)) AS chrom, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(floor(s_suppkey / 10) * 500 AS INT) AS f_start, CAST(floor(s_suppkey / 10) * 500 + 600 AS INT) AS f_end, 200 AS n_codons FROM {supplier}",
    "calls": "SELECT l_orderkey % 50 AS run_id, 'chr' || CAST(l_suppkey % 10 AS VARCHAR(9)) AS chrom, CAST(floor(l_suppkey / 10) * 500 + (l_partkey * 13 + l_linenumber) % 700 AS INT) AS pos, substr('ACGT', CAST((l_partkey + l_linenumber) % 4 AS INT) + 1, 1) AS alt, round(l_discount * 10, 2) AS af, CAST(l_quantity AS INT) AS depth FROM {lineitem}",
    "rules": "SELECT p_partkey AS rule_id, p_partkey % 100 AS feature_id, CAST((p_size * 4) % 200 AS INT) AS position, '' AS reference, substr('ACDEFGHIKLMNPQRSTVWY', CAST(p_partkey % 20 AS INT) + 1, 1) AS mutation, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, CASE p_size % 5 WHEN 0 THEN 'susceptible' WHEN 1 THEN 'possibly resistant' WHEN 2 THEN 'contradictory' WHEN 3 THEN 'intermediate' ELSE 'resistant' END AS phenotype, p_size % 7 AS score, CAST(floor(p_retailprice) AS DOUBLE) / 100 AS ic50 FROM {part}",
    "formulas": "SELECT p_partkey AS formula_id, CASE WHEN p_partkey % 2 = 0 THEN 'AND' ELSE 'OR' END AS op FROM {part}",
    "members": "SELECT p_partkey AS formula_id, p_partkey AS rule_id FROM {part} UNION ALL SELECT p_partkey, p_partkey + 100 FROM {part}",
    "effects": "SELECT s_suppkey AS feature_id, CASE WHEN s_suppkey % 3 = 0 THEN 'stop_gained' ELSE 'start_lost' END AS effect, 'drug' || CAST(s_suppkey % 7 AS VARCHAR(9)) AS drug FROM {supplier}",
    "blocks": "SELECT l_orderkey % 50 AS run_id, 'chr' || CAST(l_suppkey % 10 AS VARCHAR(9)) AS chrom, CAST((l_partkey * 17) % 3000 AS INT) AS b_start, CAST((l_partkey * 17) % 3000 + 50 + l_linenumber AS INT) AS b_end FROM {lineitem}",
    "kbs": "SELECT 'A' AS db, p_partkey AS rule_id, p_partkey % 40 AS position, substr(p_brand, 1, 7) AS gene, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, p_type AS phenotype, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE CAST(p_size % 5 AS VARCHAR(9)) END AS score, 'acc' || CAST(p_size AS VARCHAR(9)) AS accession FROM {part} UNION ALL SELECT 'B' AS db, p_partkey AS rule_id, p_partkey % 40 + p_partkey % 2 AS position, substr(p_brand, 1, 7) AS gene, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, p_type AS phenotype, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE CAST(p_size % 5 AS VARCHAR(9)) END AS score, 'acc' || CAST(p_size + 1 AS VARCHAR(9)) AS accession FROM {part} UNION ALL SELECT 'C' AS db, p_partkey AS rule_id, p_partkey % 40 + p_partkey % 3 AS position, substr(p_brand, 1, 7) AS gene, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, p_type AS phenotype, CASE WHEN p_size % 6 = 0 THEN ' ' ELSE CAST(p_size % 5 AS VARCHAR(9)) END AS score, 'acc' || CAST(p_size + 2 AS VARCHAR(9)) AS accession FROM {part}",
    "matches": "SELECT l_orderkey % 50 AS run_id, 'q' || CAST(l_partkey % 40 AS VARCHAR(9)) AS query, 'g' || CAST(l_suppkey AS VARCHAR(9)) AS feature, l_discount AS identity, l_tax AS cds_coverage, l_quantity AS query_coverage FROM {lineitem}",
    "alignments": "SELECT 'chr' || CAST(s_suppkey % 10 AS VARCHAR(9)) AS chrom, s_suppkey AS feature_id, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(floor(s_suppkey / 10) * 500 AS INT) AS query_start, CAST(floor(s_suppkey / 10) * 500 + 451 + s_suppkey % 40 AS INT) AS query_end, 0 AS cds_start, CAST(1 + s_suppkey % 40 AS INT) AS ins, CAST(3 * (1 + s_suppkey % 3) AS INT) AS del, '100M' || CAST(1 + s_suppkey % 40 AS VARCHAR(9)) || 'I200M' || CAST(3 * (1 + s_suppkey % 3) AS VARCHAR(9)) || 'D150M' AS cigar FROM {supplier}",
    "overrides": "SELECT s_suppkey AS override_no, CASE WHEN s_suppkey % 2 = 0 THEN 'ref' || CAST(s_suppkey % 10 AS VARCHAR(9)) || '.1' END AS reference, 'Drug' || CAST(s_suppkey % 6 AS VARCHAR(9)) AS drug, CAST(s_suppkey % 5 AS INT) AS thresholds FROM {supplier}",
    "insertions": "SELECT l_orderkey AS ann_id, CAST(l_suppkey % 3 AS INT) AS position, 'drug' || CAST(l_partkey % 2 AS VARCHAR(9)) AS drug, 'F' AS reference, CASE l_linenumber % 3 WHEN 0 THEN 'INS_any' WHEN 1 THEN 'FGG' ELSE 'L' END AS mutation, l_linenumber FROM {lineitem}",
    "potency": "SELECT p_partkey AS rule_id, 'org' || CAST(p_partkey % 3 AS VARCHAR(9)) AS organism, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, CASE WHEN p_partkey % 7 < 4 AND p_size % 2 = 0 THEN CAST(p_size % 10 AS DOUBLE) END AS ic50, CAST(p_size % 8 AS DOUBLE) AS fold_ic50 FROM {part}",
    "indel_calls": "SELECT l_orderkey % 50 AS run_id, 'chr' || CAST(l_suppkey % 10 AS VARCHAR(9)) AS chrom, CAST(floor(l_suppkey / 10) * 500 + (l_partkey * 13 + l_linenumber) % 700 AS INT) AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE substr('ACGTTGCAACG', 1, CAST(2 + l_partkey % 7 AS INT)) END AS ref, CASE WHEN l_linenumber % 2 = 0 THEN 'A' || substr('CGTTGACCA', 1, CAST(1 + l_partkey % 6 AS INT)) ELSE 'A' END AS alt, round(l_discount * 10, 2) AS af, CAST(l_quantity AS INT) AS depth FROM {lineitem}",
    "indel_rules": "SELECT p_partkey AS rule_id, p_partkey % 100 AS feature_id, CAST((p_size * 4) % 200 AS INT) AS position, substr('ACDEFGHIKLMNPQRSTVWY', CAST(p_partkey % 17 AS INT) + 1, CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 1 END) AS reference, CASE p_partkey % 4 WHEN 0 THEN 'INS_any' WHEN 1 THEN 'fsX' WHEN 2 THEN substr('ACDEFGHIKLMNPQRSTVWY', CAST(p_partkey % 17 AS INT) + 1, 1) || CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'T' END ELSE 'L' END AS mutation, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug FROM {part}",
    "tokens": "SELECT p_partkey, p_size AS position, 'k' AS reference, p_partkey % 14 AS kind, CASE p_partkey % 14 WHEN 0 THEN ' f' || CAST(p_size AS VARCHAR(9)) || 'stop ' WHEN 1 THEN 'F' || CAST(p_size AS VARCHAR(9)) || 'fsATFF*' WHEN 2 THEN 'F' || CAST(p_size AS VARCHAR(9)) || 'insgg' WHEN 3 THEN 'F' || CAST(p_size AS VARCHAR(9)) || 'delGG' WHEN 4 THEN 'F' || CAST(p_size AS VARCHAR(9)) || 'l' WHEN 5 THEN 'F' || CAST(p_size AS VARCHAR(9)) || 'FGG' WHEN 6 THEN 'FGG' || CAST(p_size AS VARCHAR(9)) || 'F' WHEN 7 THEN 'FG' || CAST(p_size AS VARCHAR(9)) || 'AL' WHEN 8 THEN 'del' WHEN 9 THEN 'ins_any' WHEN 10 THEN 'insGG' WHEN 11 THEN 'x' WHEN 12 THEN 'k' ELSE '' END AS raw FROM {part}",
    "runs": "SELECT o_orderkey AS run_id, o_custkey % 20 AS project_id, o_orderstatus AS selection, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'u' || CAST(o_custkey % 20 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) END AS project_uuid, o_orderdate AS created_at FROM {orders}",
    "projects": "SELECT s_suppkey AS project_id, 'u' || CAST(s_suppkey AS VARCHAR(9)) AS uuid, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1996-01-01 00:00:00' ELSE TIMESTAMP '1994-01-01 00:00:00' END AS updated_at FROM {supplier}",
    "projected": "SELECT l_orderkey % 50 AS run_id, 'chr' || CAST(l_suppkey % 10 AS VARCHAR(9)) AS chrom, l_partkey % 300 AS pos, 'A' AS ref, l_returnflag AS alt, l_discount AS identity, l_tax AS cds_coverage, l_quantity AS query_coverage, 'g' || CAST(l_suppkey AS VARCHAR(9)) AS feature, CASE WHEN l_orderkey % 40 = 0 THEN 'org1' ELSE 'org2' END AS organism FROM {lineitem}",
    "nested": "SELECT formula_id, formula_id % 5 AS project_id, drug, shape, a, b, c, CASE shape WHEN 0 THEN b || ' and ' || a WHEN 1 THEN a || ' OR ' || b WHEN 2 THEN a || ' XOR (' || c || ' XOR ' || b || ')' WHEN 3 THEN 'NOT ' || b || ' AND ' || a WHEN 4 THEN '(' || a || ' OR ' || b || ') AND ' || c WHEN 5 THEN 'NOT ' || a || ' AND NOT (' || b || ')' WHEN 6 THEN a || ' XOR ' || b WHEN 7 THEN a || ' AND ' || b || ' OR ' || c WHEN 8 THEN '(' || a || ' AND ' || b ELSE '(' || a || ' OR ' || c || ') OR ' || b END AS expression FROM (SELECT p_partkey AS formula_id, 'drug' || CAST(p_partkey % 7 AS VARCHAR(9)) AS drug, CAST(floor(p_partkey / 7) % 10 AS INT) AS shape, 'r' || CAST(p_partkey AS VARCHAR(9)) AS a, 'r' || CAST(p_partkey + 100 AS VARCHAR(9)) AS b, 'r' || CAST(p_partkey + 7 AS VARCHAR(9)) AS c FROM {part})",
    "kb_features": "SELECT s_suppkey AS feature_id, 'g' || CAST(s_suppkey AS VARCHAR(9)) AS name, 'lt' || CAST(s_suppkey % 7 AS VARCHAR(9)) AS locus_tag, CASE WHEN s_suppkey % 3 = 0 THEN 'g' || CAST(s_suppkey + 1 AS VARCHAR(9)) ELSE 'p' || CAST(s_suppkey AS VARCHAR(9)) END AS protein_id, '' AS protein, 'ref' || CAST(s_suppkey % 4 AS VARCHAR(9)) AS reference_name, 'acc' || CAST(s_suppkey % 4 AS VARCHAR(9)) || '.1' AS accession, substr('ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY', CAST(s_suppkey % 20 AS INT) + 1, 45) AS aa_sequence FROM {supplier}",
    "raw_rules": "SELECT row_no, file, kind, feature, reference_identifier, position, CASE WHEN kind = 10 THEN '' ELSE reference END AS reference, CASE kind WHEN 0 THEN 'A' WHEN 1 THEN lower(substr('CDEFG', CAST(row_no % 5 AS INT) + 1, 1)) WHEN 2 THEN reference || position || 'fs' WHEN 3 THEN 'stop' WHEN 4 THEN 'INS_any' WHEN 5 THEN reference || position || reference || 'GG' WHEN 6 THEN reference || CAST(CAST(position AS INT) + 3 AS VARCHAR(9)) || reference || 'GG' WHEN 7 THEN reference || 'KW' || position || reference WHEN 8 THEN 'del' WHEN 9 THEN 'B' WHEN 10 THEN 'L' WHEN 11 THEN reference || 'Y' || position || 'B' WHEN 12 THEN reference || position || 'BW' ELSE '' END AS mutation, member_id FROM (SELECT p_partkey AS row_no, p_partkey % 3 AS file, CAST(p_partkey % 14 AS INT) AS kind, CASE p_partkey % 4 WHEN 0 THEN 'g' || CAST(1 + p_partkey % 12 AS VARCHAR(9)) WHEN 1 THEN 'lt' || CAST(p_partkey % 9 AS VARCHAR(9)) WHEN 2 THEN 'p' || CAST(1 + p_partkey % 12 AS VARCHAR(9)) ELSE ' g' || CAST(1 + p_partkey % 10 AS VARCHAR(9)) END AS feature, CASE p_partkey % 5 WHEN 0 THEN 'ref' || CAST(p_partkey % 4 AS VARCHAR(9)) WHEN 1 THEN 'acc' || CAST(p_partkey % 4 AS VARCHAR(9)) || '.1' ELSE '' END AS reference_identifier, CAST(p_size AS VARCHAR(9)) AS position, substr('ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY', CAST((1 + p_partkey % 12) % 20 + p_size - CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END AS INT) + 1, 1) AS reference, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'm' || CAST(p_partkey % 120 AS VARCHAR(9)) END AS member_id FROM {part})",
    "links": "SELECT l_partkey AS rule_id, l_suppkey AS publication_id, l_orderkey * 10 + l_linenumber AS link_id FROM {lineitem}",
    "pubs": "SELECT s_suppkey AS publication_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '10.1/' || CAST(s_suppkey % 40 AS VARCHAR(9)) END AS doi, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR(9)) END AS pmid FROM {supplier}",
    "settings": "SELECT p_partkey % 20 AS project_id, CASE p_partkey % 3 WHEN 0 THEN 'by_score' WHEN 1 THEN 'by_ic50' ELSE 'by_fold_ic50' END AS method, CASE WHEN p_size % 4 = 0 THEN 'acc' || CAST(p_size % 3 AS VARCHAR(9)) || '.' || CAST(p_partkey % 2 AS VARCHAR(9)) END AS reference, CASE WHEN p_size % 2 = 0 THEN 'Drug' || CAST(p_size % 5 AS VARCHAR(9)) END AS drug, CASE p_partkey % 4 WHEN 0 THEN 'susceptible' WHEN 1 THEN 'Intermediate' WHEN 2 THEN 'resistant' ELSE 'odd' END AS label, CAST(p_size % 11 AS DOUBLE) - 1 + CASE WHEN p_partkey % 13 = 0 THEN 0.5 ELSE 0 END AS value FROM {part}",
    "reads": "SELECT l_orderkey % 5 AS run_id, 'chr' || CAST(l_suppkey % 3 AS VARCHAR(9)) AS chrom, 'q' || CAST(l_orderkey AS VARCHAR(9)) AS qname, CASE l_linenumber WHEN 3 THEN 1024 WHEN 4 THEN 256 ELSE 0 END AS flag, CAST(l_partkey % 40 AS BIGINT) AS pos, CAST(l_quantity AS INT) AS mapq, substr('ACGTTGCAACGTGGTCCAAT', CAST(l_partkey % 8 AS INT) + 1, 12) AS seq, l_linenumber = 2 AS gap FROM {lineitem}",
    "places": "SELECT s_suppkey % 5 AS run_id, 'chr' || CAST(s_suppkey % 3 AS VARCHAR(9)) AS chrom, s_suppkey AS codon, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand, s_suppkey % 45 AS p1, s_suppkey % 45 + 1 + s_suppkey % 2 AS p2 FROM {supplier}",
}
TABLES = ("supplier", "lineitem", "part", "orders", "events")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name].replace("VARCHAR(9)", "STRING"), **used)


def features(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """Features with their sequence in coding orientation, and their columns ``also``."""
    # Between start and stop, ``BASE`` repeats after four places.
    four = F.concat(*[F.substring(F.lit("ACGT"), ((i * 7 + i * i + F.col("feature_id")) % 4).cast("int") + 1, F.lit(1)) for i in range(4)])
    seq = F.concat(F.lit("ATG"), F.substring(F.repeat(four, F.lit(150)), 4, 594), F.lit("TAA"))
    return fixture(spark, sf_dir, "feature").select("feature_id", F.lit(0).alias("codon_start"), seq.alias("nt_sequence"), *also)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fixture(spark, sf_dir, "feature")
    return x.select("chrom", "feature_id", "strand", F.col("f_start").alias("start"), F.col("f_end").alias("end"))


def oracle(name: str) -> str:
    """A fixture as SQL on the plain tables."""
    return SQL[name].format(**{t: t for t in TABLES})
