"""The table of results that users download: a row for each annotation and rule, each annotation without, each fired formula and each effect (S-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import write_clean_tsv

# The columns in their order, those that only variant calls have, and those that go when no row says anything in them.
COLUMNS = ["reference", "gene", "nt_mut", "nt_mut_user", "strand", "aa_frequency", "depth", "consequence", "aa_effects", "in_database", "rule_type", "drug", "phenotype", "clinical_phenotype", "ic50", "fold_ic50", "score", "source", "publications"]
CALLS_ONLY = ("reference", "nt_mut_user", "depth")
IF_ANY = ("phenotype", "clinical_phenotype", "ic50", "fold_ic50", "score", "publications")
#: Stands for a missing word; missing numbers and publications are empty.
NONE = "n/a"
KEY = ["run_id", "branch", "first", "second"]
_RULE = ["drug", "phenotype", "clinical_phenotype", "ic50", "fold_ic50", "score", "source", "publications"]
_WORDS = ("drug", "phenotype", "clinical_phenotype", "source")


def _number(x: Column) -> Column:
    return F.round(x, 3).cast("string")


def aa_effects(ref_aa: Column, codon_pos: Column, alt_aa: Column, single: Column, states: Column, observed: Column) -> Column:
    """All exchanges of an annotation as ``K103N | 0.5 | lower bound``: the single one, then accepted ``states`` (``alt_aa, lower, accepted``) of another residue; what rounds to 0 is left out."""
    label = lambda aa: F.concat(ref_aa, (codon_pos + 1).cast("string"), aa)
    text = lambda aa, f: F.concat(label(aa), F.lit(" | "), _number(f), F.when(observed, F.lit(" | observed")).otherwise(" | lower bound"))
    own = F.coalesce((alt_aa != "") & (F.round(single, 3) > 0), F.lit(False))
    rest = F.filter(F.coalesce(states, F.array().cast("array<struct<alt_aa:string,lower:double,accepted:boolean>>")), lambda s: s.accepted & (F.round(s.lower, 3) > 0) & ~(own & s.alt_aa.eqNullSafe(alt_aa)))
    return F.array_join(F.concat(F.when(own, F.array(text(alt_aa, single))).otherwise(F.array().cast("array<string>")), F.transform(rest, lambda s: text(s.alt_aa, s.lower))), "; ")


def result_rows(ann: DataFrame, hits: DataFrame, formulas: DataFrame, members: DataFrame, effects: DataFrame) -> DataFrame:
    """Rows of all runs: ``KEY`` (their order) and ``COLUMNS`` as texts.

    ``ann``: ``run_id, ann_id, reference, gene, nt_mut, nt_mut_user, strand, af, depth, consequence, aa_effects``. ``hits``: ``run_id, ann_id, rule_id``, drug, labels and numbers of the rule, its ``source`` and ``publications`` (joined),
    without parts of formulas. ``formulas``: fired ones, ``run_id, formula_id, lower`` and the same of the formula; ``members``: ``run_id, formula_id, member_no, ann_id``. ``effects``: ``run_id, ann_id, drug``
    where an effect alone counts as resistant.

    An annotation gives a row (``single``) for each rule; without one, a row as ``formula-member`` if a fired formula has it, else one that is not in the database. A formula gives one row, members joined by ``;``, if it has any. Keys are of runs
    and annotations, so nothing gathers a run in one place. All sides of the joins grow with the calls, and their shuffles compress well: none is left to become a broadcast.
    """
    shared = ["reference", "gene", "nt_mut", "nt_mut_user", "strand", "aa_frequency", "depth", "consequence", "aa_effects"]
    text = lambda c, none: F.coalesce(F.col(c).cast("string"), F.lit(none)).alias(c)
    a = ann.select("run_id", "ann_id", _number(F.col("af")).alias("aa_frequency"), *[text(c, "") for c in shared if c != "aa_frequency"])
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rule = hits.select("run_id", "ann_id", "rule_id", F.lit(True).alias("_hit"), *map(one, _RULE))
    part = members.join(formulas.select("run_id", "formula_id").distinct().hint("merge"), ["run_id", "formula_id"], "left_semi").select("run_id", "ann_id").distinct().withColumn("_part", F.lit(True))
    x = a.join(rule.hint("merge"), ["run_id", "ann_id"], "left").join(part.hint("merge"), ["run_id", "ann_id"], "left")
    hit, member = F.col("_hit").isNotNull(), F.col("_part").isNotNull()
    kind = F.when(hit, "single").when(member, "formula-member").otherwise(NONE)
    lone = [F.when(hit, F.col(c)).otherwise(NONE if c in _WORDS else "").alias(c) for c in _RULE]
    key = lambda branch, first, second: [F.lit(branch).alias("branch"), F.col(first).cast("long").alias("first"), F.coalesce(second, F.lit(0)).cast("long").alias("second")]
    rows = x.select("run_id", *key(1, "ann_id", F.col("rule_id")), *shared, F.when(hit | member, "yes").otherwise("no").alias("in_database"), kind.alias("rule_type"), *lone)

    # A formula's members, in their order; they are as many as its text names.
    m = members.hint("merge").join(a, ["run_id", "ann_id"]).groupBy("run_id", "formula_id").agg(F.sort_array(F.collect_list(F.struct("member_no", "ann_id", *shared))).alias("m"))
    each = lambda c: F.array_join(F.transform("m", lambda y: y[c]), ";").alias(c)
    f = formulas.select("run_id", "formula_id", "lower", *map(one, _RULE)).join(m.hint("merge"), ["run_id", "formula_id"])
    own = {"reference": F.get("m", F.lit(0))["reference"].alias("reference"), "aa_frequency": _number(F.col("lower")).alias("aa_frequency"), "depth": F.lit("").alias("depth")}
    rows = rows.unionByName(f.select("run_id", *key(2, "formula_id", F.lit(0)), *[own.get(c, each(c)) for c in shared], F.lit("yes").alias("in_database"), F.lit("formula").alias("rule_type"), *_RULE))

    # What a row says that an effect alone brings.
    said = {"phenotype": "resistant", "clinical_phenotype": NONE, "source": "Metadata algorithm"}
    e = effects.select("run_id", "ann_id", F.trim("drug").alias("drug")).hint("merge").join(a, ["run_id", "ann_id"])
    numbered = [F.lit(said.get(c, "")).alias(c) for c in _RULE if c != "drug"]
    e = e.select("run_id", *key(3, "ann_id", F.xxhash64("drug")), *shared, F.lit("yes").alias("in_database"), F.lit("single").alias("rule_type"), "drug", *numbered)
    return rows.unionByName(e).select(*KEY, *COLUMNS)


def present_columns(rows: DataFrame, consensus: bool = False) -> list[str]:
    """Columns that a table shows: those of ``IF_ANY`` only if a row says something, those of calls not for consensus sequences (P-10)."""
    said = lambda c: (F.col(c) != "") & (F.col(c) != NONE) & (F.lower(c) != "unknown" if c.endswith("phenotype") else F.lit(True))
    has = rows.agg(*[F.max(F.coalesce(said(c), F.lit(False))).alias(c) for c in IF_ANY]).first()
    return [c for c in COLUMNS if not (consensus and c in CALLS_ONLY) and (c not in IF_ANY or has[c])]


def write_results_tsv(rows: DataFrame, path: str, consensus: bool = False) -> None:
    """The table as text files that follow each other in the order of runs; ranges of runs are sorted apart."""
    write_clean_tsv(rows.orderBy(*KEY).select("run_id", *present_columns(rows, consensus)), path)
