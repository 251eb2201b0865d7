"""Insertions and deletions inside coding features, and the rules they fulfil."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles
from ..functions import sequence as S


def _amino_acid(x: DataFrame, codon: str, aa: str) -> DataFrame:
    """Add the amino acid of a codon; the 64 codons are a broadcast table, as in ``annotate_snps``."""
    table = x.sparkSession.createDataFrame(list(S.CODONS.items()), f"{codon} string, {aa} string")
    return x.join(F.broadcast(table), codon, "left").withColumn(aa, F.coalesce(aa, F.lit("?")))


def annotate_indels(located: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """Consequences of insertions and deletions (F-7).

    ``located``: calls with ``ref, alt`` (the first base is the anchor), ``strand, feature_id, cds_pos``; ``features``:
    ``feature_id, codon_start, nt_sequence`` in coding orientation, or none if ``located`` has them already, as in ``annotate_snps``. A length that is no multiple of three is a
    frameshift. An insertion is read as anchor codon with the new bases inside: its first codon may be exchanged, the rest
    is what is inserted. A deletion inside a codon puts the bases behind it to the anchor; where the feature ends before,
    the amino acid is ``?``. So a call gives one row, or two where the anchor codon changes its amino acid. Calls whose anchor lies
    before the reading frame, or that are no indel, give none.
    """
    x = located.filter("feature_id is not null and length(ref) <> length(alt) and least(length(ref), length(alt)) > 0")
    x = x if features is None else x.join(features.hint("shuffle_hash"), "feature_id")
    start = F.coalesce("codon_start", F.lit(0))
    anchor = F.col("cds_pos") - start - F.when(F.col("strand") == "-", F.length("ref")).otherwise(0)
    coding = lambda at, n: F.upper(S.letters(F.col("nt_sequence"), start + at, n))
    x = x.withColumn("_at", anchor).filter("_at >= 0")
    inserted = F.length("alt") > F.length("ref")
    longer = F.when(inserted, F.col("alt")).otherwise(F.col("ref"))
    moved = F.upper(F.substring(longer, F.lit(2), F.length(longer)))
    x = x.withColumns({
        "codon_pos": F.floor(F.col("_at") / 3).cast("int"), "_k": F.pmod("_at", F.lit(3)).cast("int") + 1, "_ins": inserted,
        "_shift": F.abs(F.length("alt") - F.length("ref")) % 3 != 0,
        "_bases": F.when(F.col("strand") == "-", S.reverse_complement(moved)).otherwise(moved),
    })
    x = x.withColumn("ref_codon", coding(F.col("codon_pos") * 3 + 1, F.lit(3)))
    kept, lost, n = F.substring("ref_codon", F.lit(1), F.col("_k")), F.substring("ref_codon", F.col("_k") + 1, F.lit(3)), F.length("_bases")
    open_codon = F.concat(kept, "_bases", lost)
    behind = F.col("codon_pos") * 3 + F.col("_k") + n
    beyond = ~F.col("_ins") & (F.col("_k") < 3) & (behind + 3 - F.col("_k") > F.octet_length("nt_sequence") - start)
    closed = F.concat(kept, coding(behind + 1, 3 - F.col("_k")))
    gone = F.when(F.col("_k") == 3, F.col("_bases")).otherwise(coding(F.col("codon_pos") * 3 + 4, F.floor(n / 3).cast("int") * 3))
    x = x.withColumns({
        "_beyond": beyond & ~F.col("_shift"),
        "_codon": F.when(F.col("_shift") | beyond, F.col("ref_codon")).when(F.col("_ins"), F.substring(open_codon, 1, 3)).otherwise(closed),
        "_payload": F.when(F.col("_ins"), F.substring(open_codon, F.lit(4), n)).otherwise(gone),
    }).drop("nt_sequence")
    x = _amino_acid(_amino_acid(x, "ref_codon", "ref_aa"), "_codon", "_aa")
    aa, both = F.col("ref_aa"), F.concat("ref_aa", S.translate_seq(F.col("_payload")))
    row = lambda codon, a, b, kind: F.struct(codon.alias("alt_codon"), a.alias("ref_aa"), b.alias("alt_aa"), kind.alias("consequence"))
    none = F.lit("")
    indel = (
        F.when(F.col("_shift"), row(none, aa, F.concat("ref_aa", F.lit("fsX")), F.lit("frameshift")))
        .when(F.col("_beyond"), row(none, aa, F.lit("?"), F.lit("deletion")))
        .when(F.col("_ins"), row(none, aa, both, F.lit("insertion"))).otherwise(row(none, both, aa, F.lit("deletion")))
    )
    exchange = row(F.col("_codon"), aa, F.col("_aa"), S.classify_snp(aa, F.col("_aa"), F.col("codon_pos")))
    x = x.withColumn("_row", F.explode(F.when(F.col("_aa") != aa, F.array(exchange, indel)).otherwise(F.array(indel)))).drop("ref_aa")
    return x.select("*", "_row.*").drop(*[c for c in x.columns if c.startswith("_")])


def match_allele_rules(ann: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that annotations of any kind fulfil (J-4 with F-12): same feature and codon, then the allele test.

    ``rules``: ``rule_id, feature_id, position, reference, mutation, drug``. Silent exchanges and calls without frequency fulfil none.
    """
    rule = rules.select("rule_id", "feature_id", F.col("position").alias("codon_pos"), F.col("reference").alias("_r"), F.col("mutation").alias("_m"), "drug")
    found = ann.filter("consequence <> 'synonymous' and af > 0").join(rule, ["feature_id", "codon_pos"])
    return found.filter(alleles.alleles_match(F.col("_r"), F.col("_m"), F.col("ref_aa"), F.col("alt_aa"), F.col("consequence"))).drop("_r", "_m")


def anchor_mismatches(ann: DataFrame, rules: DataFrame) -> DataFrame:
    """Insertions and deletions at a rule's place whose anchor differs from the rule's, for a report (F-12b).

    An insertion rule (its mutation is longer) expects its reference as the anchor of an insertion; a deletion rule (its reference is
    longer) expects its mutation as what a deletion leaves. Returns ``run_id, rule_id, feature_id, codon_pos, consequence, expected, observed``.
    """
    rule = rules.select("rule_id", "feature_id", F.col("position").alias("codon_pos"), F.coalesce("reference", F.lit("")).alias("_r"), F.coalesce("mutation", F.lit("")).alias("_m"))
    x = ann.filter("consequence in ('insertion', 'deletion') and af > 0 and alt_aa <> ''").join(rule, ["feature_id", "codon_pos"])
    inserted = (F.col("consequence") == "insertion") & (F.length("_m") > F.length("_r"))
    deleted = (F.col("consequence") == "deletion") & (F.length("_r") > F.length("_m"))
    x = x.withColumns({"expected": F.when(inserted, F.col("_r")).when(deleted, F.col("_m")), "observed": F.when(inserted, F.col("ref_aa")).otherwise(F.col("alt_aa"))})
    return x.filter(F.col("expected") != F.col("observed")).select("run_id", "rule_id", "feature_id", "codon_pos", "consequence", "expected", "observed")
