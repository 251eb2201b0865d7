"""Rules of knowledge bases as people read them: similar rules, browsing, cards, labels and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import accession_base, label_to_rank, strength
from .rules import COMPONENT_DRUG

# Pairs of amino acids with a BLOSUM62 score of 1 or more, and of 0.
CLOSE_1 = "AS RQ RK ND NH NS DE QE QK EK HY IL IM IV LM LV MV FW FY ST WY"
CLOSE_0 = "AC AG AT AV RN RE RH NQ NE NG NK NT DQ DS QH QM QS EH ES GS IF LF KS MF TV"
_LETTERS = "ARNDCQEGHILKMFPSTWYV"


def blosum62_class(a: Column, b: Column) -> Column:
    """``high``, ``moderate`` or ``low`` likeness of two amino acids (F-26); what is no amino acid is low."""
    x, y = F.upper(a), F.upper(b)
    both = lambda text: F.concat(x, y).isin([p for w in text.split() for p in (w, w[::-1])])
    same = (x == y) & x.rlike(f"^[{_LETTERS}]$")
    return F.when(same | both(CLOSE_1), "high").when(both(CLOSE_0), "moderate").otherwise("low")


def similar_rules(ann: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules at the codon of an exchange that fulfils none, by likeness (J-5, P-12).

    ``ann``: ``run_id, feature_id, codon_pos, ref_aa, alt_aa, consequence, af``; ``hits``: ``run_id, feature_id, codon_pos, alt_aa`` of direct hits. Frameshifts, new stops and silent
    exchanges are left out. Insertions and deletions meet rules of their kind, as ``moderate``. Of several rules of a drug for one exchange the first (``rule_id``) is told.
    """
    indel = F.col("consequence").isin("insertion", "deletion") | (F.length("alt_aa") != 1)
    x = ann.filter(~F.col("consequence").isin("frameshift", "stop_gained", "synonymous") & (F.coalesce("alt_aa", F.lit("")) != ""))
    x = x.join(hits.select("run_id", "feature_id", "codon_pos", "alt_aa").distinct(), ["run_id", "feature_id", "codon_pos", "alt_aa"], "left_anti")
    x = x.groupBy("run_id", "feature_id", "codon_pos", "ref_aa", "alt_aa", "consequence").agg(F.max("af").alias("af")).withColumn("_indel", indel)
    rule = rules.filter(F.col("drug") != COMPONENT_DRUG).select("rule_id", "feature_id", F.col("position").alias("codon_pos"), "reference", "mutation", "drug")
    sized = (F.lower("mutation") == "fsx") | F.col("mutation").rlike(r"\d")
    x = x.join(rule.withColumn("_sized", sized), ["feature_id", "codon_pos"]).filter(~F.col("_indel") | F.col("_sized"))
    w = W.partitionBy("run_id", "feature_id", "codon_pos", "alt_aa", "drug").orderBy("rule_id", "consequence")
    x = x.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    alike = F.when(F.col("_indel"), "moderate").otherwise(blosum62_class(F.col("alt_aa"), F.col("mutation")))
    return x.select("run_id", "feature_id", "codon_pos", "ref_aa", "alt_aa", "drug", "rule_id", alike.alias("similarity"))


def with_publications(rules: DataFrame, links: DataFrame, publications: DataFrame, key: str = "rule_id") -> DataFrame:
    """Rules with their ``publications`` in the order of the links (J-8), an empty list for none. ``links``: key, ``publication_id, link_id``."""
    told = links.join(publications, "publication_id")
    cols = [c for c in told.columns if c not in (key, "link_id")]
    listed = told.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("link_id", F.struct(*cols).alias("p")))), lambda s: s["p"]).alias("publications"))
    kind = listed.schema["publications"].dataType
    return rules.join(listed, key, "left").withColumn("publications", F.coalesce("publications", F.array().cast(kind)))


def browse_rules(rules: DataFrame, features: DataFrame, links: DataFrame, publications: DataFrame, reference: str | None = None) -> DataFrame:
    """Rules with feature, reference and citations in one text (J-13): DOIs, or ``PMID:`` where there is none, sorted.

    ``features``: ``feature_id, name, reference_name``; ``publications``: ``publication_id, doi, pmid``. Parts of formulas are left out; ``reference`` keeps that reference's.
    """
    x = rules.filter(F.col("drug") != COMPONENT_DRUG).join(features.select("feature_id", F.col("name").alias("feature"), "reference_name"), "feature_id")
    if reference is not None:
        x = x.filter(F.col("reference_name") == reference)
    cite = F.when(F.coalesce("doi", F.lit("")) != "", F.col("doi")).when(F.coalesce("pmid", F.lit("")) != "", F.concat(F.lit("PMID:"), "pmid"))
    cited = links.join(publications, "publication_id").groupBy("rule_id").agg(F.array_join(F.sort_array(F.collect_set(cite)), "; ").alias("citations"))
    return x.join(cited, "rule_id", "left").na.fill("", ["citations"])


def load_formulas(formulas: DataFrame, members: DataFrame, rules: DataFrame, features: DataFrame) -> DataFrame:
    """Formulas with the one reference of all their members (J-7); a formula with members on several references, or unknown ones, is dropped.

    ``members``: ``formula_id, rule_id``. Adds ``reference_name, members`` (rule ids, sorted).
    """
    x = members.join(rules.select("rule_id", "feature_id"), "rule_id", "left").join(features.select("feature_id", "reference_name"), "feature_id", "left")
    whole = x.groupBy("formula_id").agg(F.count_distinct("reference_name").alias("_n"), F.count_if(F.col("reference_name").isNull()).alias("_lost"), F.min("reference_name").alias("reference_name"), F.sort_array(F.collect_set("rule_id")).alias("members"))
    return formulas.join(whole.filter("_n = 1 and _lost = 0").drop("_n", "_lost"), "formula_id")


def browse_formulas(formulas: DataFrame, labels: DataFrame) -> DataFrame:
    """Formulas with the labels of their members in place of their names, and how many members they have (J-13b).

    ``formulas``: ``formula_id, expression`` in canonical form; ``labels``: ``member, label``. Names without label stay. Adds ``readable, n_members``.
    """
    words = F.regexp_extract_all("expression", F.lit(r"([()]|[A-Za-z0-9_.:-]+)"), F.lit(1))
    name = ~F.col("word").isin("(", ")", "AND", "OR", "XOR", "NOT")
    x = formulas.select("formula_id", F.posexplode(words).alias("at", "word")).join(labels.withColumnRenamed("member", "word"), "word", "left")
    told = F.when(name, F.coalesce("label", "word")).otherwise(F.col("word"))
    x = x.groupBy("formula_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", told.alias("w")))), lambda s: s["w"]).alias("w"), F.count_distinct(F.when(name, F.col("word"))).alias("n_members"))
    text = F.replace(F.replace(F.array_join("w", " "), F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))
    return formulas.join(x.select("formula_id", text.alias("readable"), "n_members"), "formula_id")


def drug_cards(detected: DataFrame, drugs: DataFrame) -> DataFrame:
    """Drugs of each run with what the knowledge base says of them, found without regard to case (J-15). ``drugs``: ``name`` and more."""
    known = drugs.withColumn("_k", F.lower(F.trim("name"))).dropDuplicates(["_k"])
    return detected.withColumn("_k", F.lower(F.trim("drug"))).join(known, "_k", "left").drop("_k")


def phenotype_columns(hits: DataFrame) -> DataFrame:
    """Ranks that occur, most severe first and contradictory last, each with its most frequent label (A-30): ``rank, label, column_no``."""
    by = hits.groupBy(label_to_rank(F.col("phenotype")).alias("rank"), F.col("phenotype").alias("label")).agg(F.count("*").alias("n"))
    one = by.groupBy("rank").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    # One row for each of the few ranks.
    return one.withColumn("column_no", F.row_number().over(W.orderBy((F.col("rank") == -1).asc(), F.desc("rank"))))


def resolve_phenotype_mode(rules: DataFrame, by: list[str], requested: str = "phenotype") -> DataFrame:
    """Which annotation a group of rules is shown by (A-24b): the ``requested`` one (``phenotype`` or ``clinical``) where any rule has it, else phenotype, else clinical, else ``none``."""
    has = lambda c: F.bool_or(F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    x = rules.groupBy(*by).agg(has("phenotype").alias("_p"), has("clinical_phenotype").alias("_c"))
    first = F.when(F.col("_c") & F.lit(requested == "clinical"), "clinical").when(F.col("_p"), "phenotype").when(F.col("_c"), "clinical").otherwise("none")
    return x.select(*by, first.alias("mode"))


def check_settings(thresholds: DataFrame) -> DataFrame:
    """Problems of threshold settings (K-1): ``project_id, method, reference, drug, problem``, one row each.

    ``thresholds``: ``project_id, method, reference, drug, label, value``, null reference and drug for the defaults of a method. A set needs a label of ranks 1 to 5; scores are whole and above rank 1
    all values are positive; a higher rank has no lower value; one label comes once, and one (reference, drug) once, accessions without their versions.
    """
    key = ["project_id", "method", "reference", "drug"]
    x = thresholds.withColumn("rank", label_to_rank(F.col("label")))
    low = W.partitionBy(*key).orderBy("rank").rangeBetween(W.unboundedPreceding, -1)
    each = x.withColumn("_below", F.max(F.when(F.col("rank") > 0, F.col("value"))).over(low))
    bad = lambda rows, text: rows.select(*key, F.lit(text).alias("problem")).distinct()
    found = [
        bad(x.groupBy(*key).agg(F.max("rank").alias("r")).filter("r < 1"), "no severity label"),
        bad(x.filter("rank <> 1 and value <= 0"), "not positive"),
        bad(x.filter((F.col("method") == "by_score") & (F.col("value") != F.floor("value"))), "not whole"),
        bad(each.filter((F.col("method") != "by_score") & (F.col("rank") > 0) & (F.col("value") < F.col("_below"))), "falls with rank"),
        bad(x.groupBy(*key, F.lower(F.trim("label")).alias("l")).agg(F.count("*").alias("n")).filter("n > 1"), "repeated label"),
    ]
    sets = x.filter("drug is not null").select(*key).distinct()
    same = W.partitionBy("project_id", "method", accession_base(F.coalesce("reference", F.lit(""))), F.lower(F.trim("drug")))
    found.append(bad(sets.withColumn("_n", F.count("*").over(same)).filter("_n > 1"), "repeated override"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def assess_references(assessments: DataFrame) -> DataFrame:
    """Of a drug's assessments by reference the strongest, the first reference on ties (K-7, W-14): ``run_id, drug, reference, rank, label``."""
    best = F.min(F.struct((-strength(F.col("rank"))).alias("s"), "reference", "rank", "label")).alias("b")
    return assessments.groupBy("run_id", "drug").agg(best).select("run_id", "drug", "b.reference", "b.rank", "b.label")


def apply_drug_settings(hits: DataFrame, aliases: DataFrame, groups: DataFrame) -> DataFrame:
    """Hits with the alias and the group of their drugs (K-8), found without regard to case: ``shown`` (``drug (alias)``) and ``drug_group``."""
    k = F.lower(F.trim("drug"))
    a = aliases.groupBy(k.alias("_k")).agg(F.min("alias").alias("_alias"))
    g = groups.groupBy(k.alias("_k")).agg(F.min("drug_group").alias("drug_group"))
    x = hits.withColumn("_k", k).join(a, "_k", "left").join(g, "_k", "left")
    return x.withColumn("shown", F.when(F.col("_alias").isNotNull(), F.concat("drug", F.lit(" ("), "_alias", F.lit(")"))).otherwise(F.col("drug"))).drop("_k", "_alias")


def known_drugs_only(effects: DataFrame, drugs: DataFrame) -> DataFrame:
    """Effect rules of drugs that the knowledge base has (K-8)."""
    known = drugs.select(F.lower(F.trim("name")).alias("_k")).distinct()
    return effects.withColumn("_k", F.lower(F.trim("drug"))).join(known, "_k", "left_semi").drop("_k")


def pick_reference(references: DataFrame, text: str) -> DataFrame:
    """The references whose name holds ``text``, without regard to case, with how many there are (P-8): one is a choice, none or several are an error to tell."""
    found = references if text.strip().lower() in ("", "undefined", "null") else references.filter(F.lower("name").contains(text.strip().lower()))
    return found.select("name").distinct().agg(F.count("*").alias("n"), F.min("name").alias("name"))


def best_alignment(matches: DataFrame) -> DataFrame:
    """For each run and feature the match of the highest identity, the first (``query``) on ties (W-13)."""
    w = W.partitionBy("run_id", "feature").orderBy(F.desc("identity"), "query")
    return matches.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def narrow_matches(matches: DataFrame, best: DataFrame) -> DataFrame:
    """Matches of the reference chosen for each run and query (P-6). ``best``: ``run_id, query, reference``."""
    return matches.join(best.select("run_id", "query", "reference").distinct(), ["run_id", "query", "reference"], "left_semi")


def plot_features(seen: DataFrame, ruled: DataFrame) -> DataFrame:
    """Features of each run worth a plot (P-13): those seen that have rules, or, in a run where none has, all seen. ``seen``: ``run_id, feature_id``; ``ruled``: ``feature_id``."""
    x = seen.select("run_id", "feature_id").distinct().join(ruled.select("feature_id").distinct().withColumn("_r", F.lit(True)), "feature_id", "left")
    any_ = F.coalesce(F.max("_r").over(W.partitionBy("run_id")), F.lit(False))
    return x.withColumn("_any", any_).filter("_r or not _any").select("run_id", "feature_id")


def display_columns(ann: DataFrame) -> DataFrame:
    """Changes as people write them (P-14, P-15): ``nt_change`` (1-based), ``aa_change`` and ``shown``, whether the frequency is above what three digits can show."""
    nt = F.concat("ref", (F.col("pos") + 1).cast("string"), "alt")
    aa = F.when(F.coalesce("alt_aa", F.lit("")) != "", F.concat("ref_aa", (F.col("codon_pos") + 1).cast("string"), "alt_aa")).otherwise("")
    return ann.withColumns({"nt_change": nt, "aa_change": aa, "shown": F.col("af") >= 0.0005})


def all_hits(single: DataFrame, formula: DataFrame, effect: DataFrame) -> DataFrame:
    """Hits of rules, formulas and effects as one table with their ``kind`` (O-5); columns that a part lacks are null there."""
    parts = [df.withColumn("kind", F.lit(k)) for k, df in (("rule", single), ("formula", formula), ("effect", effect))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def uncovered_contigs(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Contigs of a run's calls without a query record (J-11, O-7): ``run_id, chrom``; a run with any must not be profiled."""
    return calls.select("run_id", "chrom").distinct().join(records.select("chrom").distinct(), "chrom", "left_anti").select("run_id", "chrom")


def protein_url(protein_id: Column, page: str = "https://www.ncbi.nlm.nih.gov/protein/{}") -> Column:
    """Address of a protein's page if the id is an accession with a version (F-28), else empty."""
    t = F.trim(protein_id)
    fine = F.upper(t).rlike(r"^([A-Z]{3}[0-9]{5}|[A-Z]{2}_[0-9]{6,9}|[A-Z]{4}[0-9]{8,10})\.[0-9]+$")
    return F.when(fine, F.concat(F.lit(page.split("{}")[0]), t, F.lit(page.split("{}")[1]))).otherwise("")


def sample_name(path: Column) -> Column:
    """Sample of a result file (F-29): its name without a 20-digit stamp and ``.results.json``."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.\d{20}(?=\.(report\.html|report\.pdf|results\.json)$)", "")
    return F.regexp_replace(name, r"(?<=.)\.results\.json$", "")


def strand_sign(token: Column) -> Column:
    """``+`` or ``-`` of a strand as files write it (F-34); null if it is not understood."""
    return F.when(token.isin("+", "1", "plus", "forward"), "+").when(token.isin("-", "-1", "minus", "reverse"), "-")


def intron_gaps(segments: Column) -> Column:
    """Stretches between the exons of a feature (F-32): ``start, end``. ``segments``: ``start, end``, in any order."""
    s = F.array_sort(segments)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda i: F.struct(F.get(s, i - 1)["end"].alias("start"), F.get(s, i)["start"].alias("end")))
    return F.filter(pairs, lambda p: p["end"].isNotNull() & (p["end"] > p["start"]))


def codon_nt_span(codon_start: Column, first: Column, last: Column) -> Column:
    """Coding bases ``start, end`` of an inclusive range of codons (F-31)."""
    return F.struct((codon_start + first * 3).alias("start"), (codon_start + (last + 1) * 3).alias("end"))
