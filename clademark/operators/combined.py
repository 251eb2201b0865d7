"""Exchanges that share a codon: what each shows, and the rules that their combined effects fulfil."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import alleles
from ..functions import sequence as S
from .codon import frechet_list, offsets, places

CODON = ["run_id", "feature_id", "codon_pos"]
MEMBER = [*CODON, "codon_offset", "coding_alt"]


def combined_annotations(ann: DataFrame, min_fraction: float = 2 / 3, eps: float = 1e-9) -> DataFrame:
    """One row for each exchange, with what its codon shows as a whole (A-4b, W-8).

    ``ann``: exchanges as ``annotate_snps`` gives them; calls of one exchange in a run count once, with the highest frequency.
    In a codon with several places, of which an accepted state carries an exchange, a row's ``effect_freq`` is the lower bound of the state
    with that exchange alone, and ``states`` are the accepted states that carry it, by amino acid (``aa, codon, lower,
    upper, forced``). Where the exchange alone is impossible and a state carries it for certain (``forced`` 1), the row shows that state in place of it: of several
    that with most exchanges, then the higher bound. All other exchanges keep their own frequency and have no states.
    """
    # One shuffle by codon serves the calls of an exchange and the exchanges of a codon; only codons with several places have lists of states.
    x = ann.repartition(*CODON).groupBy(*MEMBER, "ref_codon", "alt_codon", "ref_aa", "alt_aa", "consequence").agg(F.max("af").alias("af"))
    # By a hash first: rows are sorted by it alone almost always, whichever of the keys has few values.
    together = W.partitionBy("_h", *CODON, "ref_codon")
    x = x.withColumn("_h", F.xxhash64(*CODON)).withColumn("_m", F.collect_list(F.struct("codon_offset", F.col("coding_alt").alias("base"), "af")).over(together)).drop("_h")
    several = (F.size("_m") > 1) & (F.size(offsets(F.col("_m"))) > 1)
    for c in CODON:
        several &= F.col(c).isNotNull()
    x = x.withColumn("_p", F.when(several, places(F.sort_array("_m")))).drop("_m")
    x = x.withColumn("_s", F.when(F.col("_p").isNotNull(), frechet_list(F.col("_p"), min_fraction, eps))).drop("_p")
    x = x.withColumn("_s", F.when(F.exists("_s", lambda s: s["accepted"]), F.filter("_s", lambda s: F.substring(s["codon"], F.col("codon_offset") + 1, F.lit(1)) == F.col("coding_alt"))))
    alone = F.get(F.filter("_s", lambda s: s["size"] == 1), F.lit(0))["lower"]
    sure = F.filter("_s", lambda s: s["accepted"] & (F.abs(s["forced"] - 1) <= eps))
    rank = F.transform(sure, lambda s: F.struct(s["size"], F.round(s["lower"], 9).alias("lower"), (-s["state_no"]).alias("no"), s["codon"].alias("codon"), s["aa"].alias("aa"), s["lower"].alias("full")))
    x = x.withColumns({"_alone": F.coalesce(alone, F.lit(0.0)), "_sure": F.array_max(rank), "combined": F.col("_s").isNotNull()})
    x = x.withColumn("_up", F.coalesce(F.col("combined") & (F.col("_alone") <= eps) & F.col("_sure").isNotNull(), F.lit(False)))
    carried = F.filter("_s", lambda s: s["accepted"] & ~(F.col("_up") & (s["state_no"] == -F.col("_sure.no"))))
    by_aa = lambda a: F.filter(carried, lambda s: s["aa"] == a)
    one = lambda a: F.struct(
        a.alias("aa"), F.get(by_aa(a), F.lit(0))["codon"].alias("codon"), F.aggregate(by_aa(a), F.lit(0.0), lambda t, s: t + s["lower"]).alias("lower"),
        F.array_max(F.transform(by_aa(a), lambda s: s["upper"])).alias("upper"), F.array_max(F.transform(by_aa(a), lambda s: s["forced"])).alias("forced"),
    )
    states = F.transform(F.array_distinct(F.transform(carried, lambda s: s["aa"])), one)
    aa = F.when(F.col("_up"), F.col("_sure.aa")).otherwise(F.col("alt_aa"))
    x = x.withColumns({"states": F.coalesce(states, F.array().cast("array<struct<aa:string,codon:string,lower:double,upper:double,forced:double>>")), "_aa": aa})
    x = x.withColumns({
        "effect_freq": F.when(F.col("_up"), F.col("_sure.full")).when(F.col("combined"), F.col("_alone")).otherwise(F.col("af")),
        "freq_method": F.when(F.col("combined"), "estimated").otherwise("observed"),
        "alt_codon": F.when(F.col("_up"), F.col("_sure.codon")).otherwise(F.col("alt_codon")),
        "consequence": F.when(F.col("_up"), S.classify_snp(F.col("ref_aa"), F.col("_aa"), F.col("codon_pos"))).otherwise(F.col("consequence")), "alt_aa": F.col("_aa"),
    })
    return x.drop(*[c for c in x.columns if c.startswith("_")])


def match_effects(ann: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that exchanges fulfil alone or by a combined state (J-4 over ``combined_annotations``).

    Of the effects of a row that fulfil a rule, a state with another amino acid than the row's own counts first, then a state with the same (W-7). Members of
    a codon that fulfil a rule by the same effect report it once, the first of them (W-6). ``rules``: ``rule_id, feature_id, position, reference,
    mutation, drug``. Returns the members' keys with ``rule_id, drug, effect_aa, effect_freq``.
    """
    own = F.struct(F.lit(0).alias("no"), F.col("alt_aa").alias("aa"), F.col("effect_freq").alias("lower"), F.col("consequence").alias("kind"))
    single = F.when((F.col("consequence") != "synonymous") & (F.col("effect_freq") > 0), own)
    kind = lambda s: F.when(s["aa"] == F.col("alt_aa"), F.col("consequence")).otherwise("missense")
    others = F.transform(F.filter("states", lambda s: (s["lower"] > 0) & ~s["aa"].isin("", "?")), lambda s, i: F.struct((i + 1).alias("no"), s["aa"].alias("aa"), s["lower"].alias("lower"), kind(s).alias("kind")))
    effects = ann.select(*MEMBER, "ref_aa", "alt_aa", "combined", F.explode(F.concat(F.array_compact(F.array(single)), others)).alias("e"))
    rule = rules.select("rule_id", "feature_id", F.col("position").alias("codon_pos"), F.col("reference").alias("_r"), F.col("mutation").alias("_m"), "drug")
    x = effects.join(rule, ["feature_id", "codon_pos"]).filter(alleles.alleles_match(F.col("_r"), F.col("_m"), F.col("ref_aa"), F.col("e.aa"), F.col("e.kind")))
    other = F.col("e.aa") != F.col("alt_aa")
    choice = W.partitionBy(*MEMBER, "rule_id").orderBy(other.desc(), F.when(other, F.col("e.no")).otherwise(-F.col("e.no")))
    x = x.withColumn("_n", F.row_number().over(choice)).filter("_n = 1")
    once = W.partitionBy(*CODON, "e.aa", "rule_id").orderBy("combined", "codon_offset", "coding_alt")
    x = x.withColumn("_n", F.sum(F.col("combined").cast("int")).over(once.rowsBetween(W.unboundedPreceding, W.currentRow))).filter("not combined or _n = 1")
    return x.select(*MEMBER, "rule_id", "drug", F.col("e.aa").alias("effect_aa"), F.col("e.lower").alias("effect_freq"))
