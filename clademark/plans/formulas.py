"""Registered queries of nested formulas and of codons with several exchanges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combined, formulas, rules
from . import fixtures
from .catalog import W_BEST, W_PLACES, annotations, hits, query, r6
from .fixtures import fixture
from .variants import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

W_NESTED = f"nested AS ({fixtures.oracle('nested')})"


def _compiled(spark, d):
    return formulas.compiled(fixture(spark, d, "nested"))


def _evidence(spark, d):
    ev = rules.best_member_evidence(hits(spark, d), 1e-6)
    return ev.select("run_id", F.concat(F.lit("r"), F.col("rule_id").cast("string")).alias("member"), F.col("af").alias("lower"))


_RUNS = "runs AS (SELECT DISTINCT run_id, run_id % 5 AS project_id FROM ann)"


def _runs(spark, d):
    return annotations(spark, d).select("run_id").distinct().withColumn("project_id", F.col("run_id") % 5)


def _fired(spark, d):
    return formulas.evaluate_formulas(_runs(spark, d), _evidence(spark, d), _compiled(spark, d), eps=1e-6)


def _canonical_sql() -> str:
    lo, hi = "least(a, b)", "greatest(a, b)"
    two = lambda op: f"'(' || {lo} || ' {op} ' || {hi} || ')'"
    many = lambda op: f"'(' || array_to_string(list_sort([a, b, c]), ' {op} ') || ')'"
    cases = {0: two("AND"), 1: two("OR"), 2: many("XOR"), 3: "'(' || a || ' AND (NOT ' || b || '))'", 4: f"'(' || c || ' AND ' || {two('OR')} || ')'", 5: f"'((NOT ' || {lo} || ') AND (NOT ' || {hi} || '))'", 6: two("XOR"), 7: f"'(' || c || ' OR ' || {two('AND')} || ')'", 9: many("OR")}
    return "CASE shape " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


@query(f"WITH {W_NESTED} SELECT formula_id, {_canonical_sql()} AS canonical, CASE shape WHEN 8 THEN 'unbalanced parentheses' END AS problem FROM nested")
def f30_formula_canonical(spark, d):
    return _compiled(spark, d).select("formula_id", "canonical", "problem")


_LOW = lambda *q: f"least(greatest(0, {' + '.join(q)} - {len(q) - 1}), least({', '.join(q)}))"
_OK = lambda *q: f"({_LOW(*q)} > 1e-6 AND {_LOW(*q)} / least({', '.join(q)}) >= 2.0 / 3 - 1e-6)"
W_EVAL = f"""{W_BEST}, {_RUNS}, {W_NESTED}, e AS (SELECT run_id, 'r' || CAST(rule_id AS VARCHAR) AS member, af FROM ev WHERE af > 1e-6),
 q AS (SELECT r.run_id, f.*, coalesce(x.af, 0) AS qa, coalesce(y.af, 0) AS qb, coalesce(z.af, 0) AS qc FROM runs r JOIN nested f ON r.project_id = f.project_id
  LEFT JOIN e x ON x.run_id = r.run_id AND x.member = a LEFT JOIN e y ON y.run_id = r.run_id AND y.member = b LEFT JOIN e z ON z.run_id = r.run_id AND z.member = c),
 p AS (SELECT *, qa > 0 AS pa, qb > 0 AS pb, qc > 0 AS pc, CASE WHEN qa > qb OR (qa = qb AND a < b) THEN a ELSE b END AS ab, greatest(qa, qb) AS qab FROM q),
 fired AS (
  SELECT run_id, formula_id, [a, b] AS m, {_LOW('qa', 'qb')} AS low FROM p WHERE shape = 0 AND pa AND pb AND {_OK('qa', 'qb')}
  UNION ALL SELECT run_id, formula_id, [ab], qab FROM p WHERE shape = 1 AND (pa OR pb)
  UNION ALL SELECT run_id, formula_id, [CASE WHEN pa THEN a WHEN pb THEN b ELSE c END], qa + qb + qc FROM p WHERE shape = 2 AND CAST(pa AS INT) + CAST(pb AS INT) + CAST(pc AS INT) = 1
  UNION ALL SELECT run_id, formula_id, [a, b, c], {_LOW('qa', 'qb', 'qc')} FROM p WHERE shape = 2 AND pa AND pb AND pc AND {_OK('qa', 'qb', 'qc')}
  UNION ALL SELECT run_id, formula_id, [a], qa FROM p WHERE shape = 3 AND pa AND NOT pb
  UNION ALL SELECT run_id, formula_id, [ab, c], {_LOW('qab', 'qc')} FROM p WHERE shape = 4 AND (pa OR pb) AND pc AND {_OK('qab', 'qc')}
  UNION ALL SELECT run_id, formula_id, [], 0 FROM p WHERE shape = 5 AND NOT pa AND NOT pb
  UNION ALL SELECT run_id, formula_id, [CASE WHEN pa THEN a ELSE b END], qab FROM p WHERE shape = 6 AND pa <> pb
  UNION ALL SELECT run_id, formula_id, CASE WHEN pc AND (NOT ab_ok OR qc > qab OR (qc = qab AND c < least(a, b))) THEN [c] ELSE [a, b] END, CASE WHEN pc AND (NOT ab_ok OR qc > qab OR (qc = qab AND c < least(a, b))) THEN qc ELSE {_LOW('qa', 'qb')} END
   FROM (SELECT *, pa AND pb AND {_OK('qa', 'qb')} AS ab_ok FROM p) WHERE shape = 7 AND (pc OR ab_ok)
  UNION ALL SELECT run_id, formula_id, [CASE WHEN greatest(qab, qc) = qc AND (qc > qab OR c < ab) THEN c ELSE ab END], greatest(qab, qc) FROM p WHERE shape = 9 AND (pa OR pb OR pc))"""


@query(f"WITH {W_EVAL} SELECT run_id, formula_id, coalesce(array_to_string(list_sort(m), ','), '') AS members, round(low, 6) AS lower FROM fired")
def a8_nested_formulas(spark, d):
    return r6(_fired(spark, d).select("run_id", "formula_id", F.array_join("members", ",").alias("members"), "lower"), "lower")


@query(f"WITH {W_EVAL} SELECT run_id, formula_id, coalesce(array_to_string(list_sort(m), ','), '') AS members FROM fired JOIN nested USING (formula_id) WHERE NOT (shape IN (1, 9) AND EXISTS (SELECT 1 FROM hits h WHERE h.run_id = fired.run_id AND 'r' || CAST(h.rule_id AS VARCHAR) = m[1] AND h.drug = nested.drug))")
def a8b_without_repeated_rules(spark, d):
    told = hits(spark, d).select("run_id", F.concat(F.lit("r"), F.col("rule_id").cast("string")).alias("member"), "drug")
    x = formulas.without_repeated_rules(_fired(spark, d), _compiled(spark, d), told)
    return x.select("run_id", "formula_id", F.array_join("members", ",").alias("members"))


W_COMBINED = W_PLACES + """, mem AS MATERIALIZED (SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, ref_codon, alt_codon, ref_aa, alt_aa, consequence, max(af) AS af FROM ann GROUP BY ALL),
 st AS MATERIALIZED (SELECT *, (lower > 1e-6 AND lower / nullif(upper, 0) >= 2.0 / 3 - 1e-6) IS TRUE AS accepted FROM states WHERE size > 0),
 has AS (SELECT DISTINCT run_id, feature_id, codon_pos FROM st WHERE accepted),
 carry AS MATERIALIZED (SELECT m.run_id, m.feature_id, m.codon_pos, m.codon_offset, m.coding_alt, st.state_no, st.codon, st.aa, st.size, st.lower, st.upper, st.forced, st.accepted FROM mem m JOIN has USING (run_id, feature_id, codon_pos) JOIN st ON st.run_id = m.run_id AND st.feature_id = m.feature_id AND st.codon_pos = m.codon_pos AND substr(st.codon, CAST(m.codon_offset AS INT) + 1, 1) = m.coding_alt),
 own AS (SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, coalesce(max(lower) FILTER (size = 1), 0) AS alone,
  arg_max({'no': state_no, 'codon': codon, 'aa': aa, 'lower': lower}, (size, round(lower, 9), -state_no)) FILTER (accepted AND abs(forced - 1) <= 1e-6) AS sure FROM carry GROUP BY ALL),
 com AS (SELECT m.*, o.run_id IS NOT NULL AS combined, coalesce(alone <= 1e-6 AND sure IS NOT NULL, FALSE) AS up, alone, sure FROM mem m LEFT JOIN own o USING (run_id, feature_id, codon_pos, codon_offset, coding_alt)),
 shown AS MATERIALIZED (SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, ref_codon, ref_aa, combined, up, sure, CASE WHEN up THEN sure.codon ELSE alt_codon END AS alt_codon, CASE WHEN up THEN sure.aa ELSE alt_aa END AS alt_aa, CASE WHEN up THEN sure.lower WHEN combined THEN alone ELSE af END AS effect_freq, consequence AS was FROM com),
 comb AS MATERIALIZED (SELECT * EXCLUDE (was), CASE WHEN NOT up THEN was WHEN ref_aa = '?' OR alt_aa = '?' THEN 'unknown' WHEN ref_aa = alt_aa THEN 'synonymous' WHEN codon_pos = 0 AND ref_aa = 'M' THEN 'start_lost' WHEN alt_aa = '*' THEN 'stop_gained' WHEN ref_aa = '*' THEN 'stop_loss' ELSE 'missense' END AS consequence FROM shown),
 also AS MATERIALIZED (SELECT c.run_id, c.feature_id, c.codon_pos, c.codon_offset, c.coding_alt, y.aa, sum(y.lower) AS lower, min(y.state_no) AS no FROM comb c JOIN carry y USING (run_id, feature_id, codon_pos, codon_offset, coding_alt) WHERE y.accepted AND NOT (c.up AND y.state_no = c.sure.no) GROUP BY ALL)"""


def _combined(spark, d, about=None):
    return combined.combined_annotations(annotations(spark, d, about), eps=1e-6)


@query(f"WITH {W_COMBINED}, l AS (SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, string_agg(aa, ',' ORDER BY no) AS states, sum(lower) AS total FROM also GROUP BY ALL) SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, alt_codon, alt_aa, consequence, round(effect_freq, 6) AS effect_freq, CASE WHEN combined THEN 'estimated' ELSE 'observed' END AS freq_method, coalesce(states, '') AS states, round(coalesce(total, 0), 6) AS total FROM comb LEFT JOIN l USING (run_id, feature_id, codon_pos, codon_offset, coding_alt)")
def a4b_combined_annotations(spark, d):
    total = F.aggregate("states", F.lit(0.0), lambda t, s: t + s["lower"])
    x = _combined(spark, d).select("run_id", "feature_id", "codon_pos", "codon_offset", "coding_alt", "alt_codon", "alt_aa", "consequence", "effect_freq", "freq_method", F.array_join(F.col("states.aa"), ",").alias("states"), total.alias("total"))
    return r6(x, "effect_freq", "total")


@query(f"""WITH {W_COMBINED}, r AS ({fixtures.oracle('rules')}),
 eff AS (SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, combined, 0 AS no, alt_aa AS aa, effect_freq AS lower, FALSE AS other FROM comb WHERE consequence <> 'synonymous' AND effect_freq > 0
  UNION ALL SELECT c.run_id, c.feature_id, c.codon_pos, c.codon_offset, c.coding_alt, c.combined, y.no + 1, y.aa, y.lower, y.aa <> c.alt_aa FROM comb c JOIN also y USING (run_id, feature_id, codon_pos, codon_offset, coding_alt) WHERE y.lower > 0 AND y.aa <> '?'),
 fit AS (SELECT eff.*, r.rule_id, r.drug FROM eff JOIN r ON eff.feature_id = r.feature_id AND eff.codon_pos = r.position AND eff.aa = r.mutation
  QUALIFY row_number() OVER (PARTITION BY run_id, eff.feature_id, codon_pos, codon_offset, coding_alt, rule_id ORDER BY other DESC, CASE WHEN other THEN no ELSE -no END) = 1)
 SELECT run_id, feature_id, codon_pos, codon_offset, coding_alt, rule_id, drug, aa AS effect_aa, round(lower, 6) AS effect_freq FROM fit
 QUALIFY NOT combined OR row_number() OVER (PARTITION BY run_id, feature_id, codon_pos, aa, rule_id, combined ORDER BY codon_offset, coding_alt) = 1""")
def w6_match_effects(spark, d):
    """Codons are combined in features with rules only, as those of others fulfil none."""
    rules = fixture(spark, d, "rules")
    return r6(combined.match_effects(_combined(spark, d, rules), rules), "effect_freq")
