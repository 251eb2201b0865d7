"""Checks and steps by which written rules and formulas become a knowledge base, all rows at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alleles import let, normalize_mutation

# Fixed value: what a comment says where publications disagree.
CONTRADICTORY = "Publications have contradictory phenotype associations."
# Fixed value: the letters of amino acids.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
_WRITTEN = r"^([A-Z*]+)(\d+)([A-Z*]+)$"


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def contradictory_comment(comment: Column, phenotype: Column, clinical: Column) -> Column:
    """A comment that says so where a label is contradictory (F-25), once, as a sentence of its own."""
    c = F.trim(F.coalesce(comment, F.lit("")))
    said = F.when(F.lower(c).contains(CONTRADICTORY.lower()), c).when(c == "", CONTRADICTORY).when(c.rlike(r"[.!?]$"), F.concat(c, F.lit(" " + CONTRADICTORY))).otherwise(F.concat(c, F.lit(". " + CONTRADICTORY)))
    return F.when((phenotype == "contradictory") | (clinical == "contradictory"), said).otherwise(comment)


def split_anchor_changed(rules: DataFrame, by: str | None = None) -> DataFrame:
    """Insertions and deletions that also exchange their anchor, as two rules (F-10).

    ``GY50A`` is the exchange ``G`` to ``A`` and the deletion ``GY`` to ``G``; ``G50AW`` the exchange and the insertion ``G`` to ``GW``. The two get the suffixes ``__sub`` and ``__indel``
    on their ``member_id`` (made from ``row_no``, and a hash of ``by`` if given, where there is none). Rows whose place or reference says otherwise stay as they are.
    """
    m = F.upper(_blank("mutation"))
    left, place, right = (F.regexp_extract(m, _WRITTEN, i) for i in (1, 2, 3))
    a, b = F.substring(left, F.lit(2), F.length(left)), F.substring(right, F.lit(2), F.length(right))
    longer = (b.startswith(a) & (F.length(b) > F.length(a))) | (a.startswith(b) & (F.length(a) > F.length(b)))
    word = m.rlike(r"DEL$|INS|FRAMESHIFT|STOP") | right.rlike(r"^(DEL|INS|FS|STOP)")
    ref = F.upper(_blank("reference"))
    fits = (place != "") & (place.try_cast("long") == _blank("position").try_cast("long")) & ((ref == "") | (ref == left) | (ref == F.substring(left, 1, 1)))
    mixed = F.coalesce(fits & ~word & (F.substring(left, 1, 1) != F.substring(right, 1, 1)) & longer, F.lit(False))
    # The names of the two parts.
    name = F.when(_blank("member_id") != "", _blank("member_id")).otherwise(F.concat(F.lit("__auto_anchor_split_row_"), F.col("row_no").cast("string"), *([F.lit("_"), F.substring(F.sha1(F.col(by).cast("string")), 1, 8)] if by else [])))
    row = lambda r, x, i: F.struct(r.alias("reference"), x.alias("mutation"), i.alias("member_id"))
    first = F.substring(left, 1, 1)
    two = F.array(row(first, F.substring(right, 1, 1), F.concat(name, F.lit("__sub"))), row(left, F.concat(first, b), F.concat(name, F.lit("__indel"))))
    rest = [c for c in rules.columns if c not in ("reference", "mutation", "member_id")]
    return rules.select(*rest, F.inline(F.when(mixed, two).otherwise(F.array(row(*map(F.col, ("reference", "mutation", "member_id")))))))


def resolve_rule_feature(rules: DataFrame, features: DataFrame) -> DataFrame:
    """The feature that each rule means (J-9): adds ``feature_id``, ``aa_sequence`` and ``problem``.

    A rule names a feature by its ``name`` or, if no feature has that name, by ``locus_tag``, ``protein_id`` or ``protein``; a reference that it gives must be the
    feature's by name or accession. Several features are a problem, as is none.
    """
    alias = F.posexplode(F.array(*[_blank(c) for c in ("name", "locus_tag", "protein_id", "protein")])).alias("_rank", "_key")
    known = features.select("feature_id", "aa_sequence", "reference_name", "accession", alias).filter("_key <> ''")
    named = known.filter("_rank = 0").select("_key").distinct().withColumn("_own", F.lit(True))
    known = known.join(named, "_key", "left").filter("_own is null or _rank = 0")
    # What a name and a reference mean is decided once, however many rules say them and features share them.
    known = known.withColumn("_given", F.explode(F.array_distinct(F.array(F.lit(""), "reference_name", "accession"))))
    lowest = F.struct("feature_id", "aa_sequence")
    known = known.groupBy("_key", "_given").agg(F.min(lowest).alias("_f"), (F.min("feature_id") == F.max("feature_id")).alias("_single"))
    known = known.select("_key", "_given", F.when(F.col("_single"), 1).otherwise(2).alias("_n"), F.when(F.col("_single"), F.col("_f")).alias("_f"))
    x = rules.withColumns({"_key": _blank("feature"), "_given": _blank("reference_identifier")}).join(known, ["_key", "_given"], "left").drop("_key", "_given")
    one = F.col("_n") == 1
    problem = F.when(F.col("_n").isNull(), "unknown feature").when(~one, "ambiguous feature")
    return x.withColumns({"feature_id": F.when(one, F.col("_f.feature_id")), "aa_sequence": F.when(one, F.col("_f.aa_sequence")), "problem": problem}).drop("_n", "_f")


def _letter(seq: str, at: Column) -> Column:
    return F.when(at >= 0, F.upper(F.substring(F.col(seq), at + 1, F.lit(1))))


def detect_coordinate_base(rules: DataFrame, by: str = "file") -> DataFrame:
    """Whether each file counts positions from 1 or from 0 (A-17): ``base``, and how many rows could be checked and fit either way.

    ``rules``: resolved ones, with ``aa_sequence``. More fits win; ties, and files that nothing verifies, count from 1; where no row fits, ``base`` is null, an error.
    """
    at, ref = _blank("position").try_cast("int"), F.upper(F.substring(_blank("reference"), 1, 1))
    x = rules.filter((_blank("reference") != "") & at.isNotNull() & (F.coalesce(F.length("aa_sequence"), F.lit(0)) > 0))
    x = x.groupBy(by).agg(F.count("*").alias("checked"), F.count_if(_letter("aa_sequence", at - 1) == ref).alias("from_1"), F.count_if(_letter("aa_sequence", at) == ref).alias("from_0"))
    out = rules.select(by).distinct().join(x, by, "left").na.fill(0, ["checked", "from_1", "from_0"])
    return out.withColumn("base", F.when(F.col("checked") == 0, 1).when(F.col("from_0") > F.col("from_1"), 0).when(F.col("from_1") > 0, 1))


def validate_reference_aa(rules: DataFrame, base: DataFrame, by: str = "file") -> DataFrame:
    """Rows whose reference residues are not those of the feature (A-18): adds ``skip``, a reason or null. ``base`` as ``detect_coordinate_base`` gives it."""
    x = rules.join(F.broadcast(base.select(by, "base")), by, "left")
    at, ref = _blank("position").try_cast("int") - F.col("base"), F.upper(_blank("reference"))
    checked = (ref != "") & at.isNotNull() & (F.coalesce(F.length("aa_sequence"), F.lit(0)) > 0)
    outside = (at < 0) | (at + F.length(ref) > F.length("aa_sequence"))
    wrong = F.upper(F.substring("aa_sequence", at + 1, F.length(ref))) != ref
    return x.withColumn("skip", F.when(checked & outside, "out of range").when(checked & wrong, "reference mismatch")).drop("base")


def resolve_anchorless_deletion(block: Column, position: Column, aa_seq: Column) -> Column:
    """A deletion without anchor, at a 0-based position, by the residue before it (F-11): ``position, reference, mutation``, or null if the sequence says otherwise."""
    b, n = F.upper(block), F.length(block)
    anchor = F.upper(F.substring(aa_seq, position, F.lit(1)))
    fits = (position >= 1) & (position + n <= F.length(aa_seq)) & (F.upper(F.substring(aa_seq, position + 1, n)) == b)
    return F.when(fits, F.struct((position - 1).alias("position"), anchor.alias("reference"), F.concat(anchor, b, position.cast("string"), anchor).alias("mutation")))


def rule_alleles(reference: Column, mutation: Column, position: Column) -> Column:
    """Stored form of a rule's alleles (F-9): ``position`` (0-based), ``reference, mutation, problem``.

    ``problem``: ``blank``, ``unrecognised``, ``position conflict`` (the mutation names another place), ``no change`` or ``unsupported``.
    """
    ref, raw = F.upper(F.trim(F.coalesce(reference, F.lit("")))), F.trim(F.coalesce(mutation, F.lit("")))
    m = F.upper(raw)
    direct = raw.rlike(r"^[A-Za-z*]+$") & ~m.startswith("INS") & (m != "DEL")
    shift = F.concat(ref, F.lit("fsX"))
    token = F.when(m.isin("*", "STOP"), "*").when(m.rlike(r"^(FS|FRAMESHIFT)") | m.rlike(r"^.FSX$"), shift).otherwise(m)
    other = normalize_mutation(raw, ref, position + 1)
    stored = F.when(direct, token).otherwise(let(other, lambda o: F.when(o == "fsX", shift).otherwise(o)))
    written = lambda t: F.struct(t.alias("t"), *(F.regexp_extract(F.upper(t), _WRITTEN, i).alias(n) for i, n in enumerate(("left", "place", "right"), 1)))
    return let(stored, lambda t: let(written(t), lambda p: _stored_alleles(p, ref, raw, position)))


def _stored_alleles(p: Column, ref: Column, raw: Column, position: Column) -> Column:
    t, left, place, right = (p[n] for n in ("t", "left", "place", "right"))
    swap = (F.length(left) == 1) & (F.length(right) == 1)
    conflict = (place != "") & ~swap & (place.cast("long") != position + 1)
    r = F.when((place != "") & ~swap, left).otherwise(ref)
    x = F.when(place != "", right).otherwise(t)
    known = (x == "INS_any") | F.upper(x).isin("FSX", "*") | F.upper(x).rlike(r"^.FSX$") | (F.upper(x).rlike(f"^[{RESIDUES}]+$") & (F.upper(x) != "ANY"))
    problem = (
        F.when((ref == "") | (raw == ""), "blank").when(t.isNull(), "unrecognised").when(conflict, "position conflict")
        .when(F.upper(r) == F.upper(x), "no change").when(~known, "unsupported")
    )
    return F.struct(position.alias("position"), r.alias("reference"), x.alias("mutation"), problem.alias("problem"))


def first_definition(rules: DataFrame, signature: list[str]) -> DataFrame:
    """Repeated external ids (W-4): adds ``repeat``, ``stripped`` for a row that repeats the first definition of its ``member_id`` (which it loses) and ``conflict`` for one that differs from it."""
    blank = _blank("member_id") == ""
    w = W.partitionBy(F.when(blank, F.col("row_no").cast("string")).otherwise(F.concat(F.lit("m"), _blank("member_id")))).orderBy("row_no")
    first, own = F.first(F.struct(*signature)).over(w), F.struct(*signature)
    x = rules.withColumns({"_n": F.row_number().over(w), "_same": first.eqNullSafe(own)})
    again = ~blank & (F.col("_n") > 1)
    x = x.withColumn("repeat", F.when(again & F.col("_same"), "stripped").when(again, "conflict"))
    return x.withColumn("member_id", F.when(F.col("repeat") == "stripped", "").otherwise(F.col("member_id"))).drop("_n", "_same")


def dedupe_formulas(formulas: DataFrame) -> DataFrame:
    """Repeated formulas (W-4b): adds ``repeat``. First ``formula`` for a drug's canonical text that was there before, then ``id`` for an id that a formula before, not itself a repeat, has."""
    by_text = W.partitionBy(F.lower("drug"), "canonical").orderBy("row_no")
    x = formulas.withColumn("_t", F.row_number().over(by_text))
    # Ids count among the formulas that are no repeats; the first of an id is never dropped for its id.
    by_id = W.partitionBy("formula_id", F.col("_t") == 1).orderBy("row_no")
    x = x.withColumn("_i", F.row_number().over(by_id))
    return x.withColumn("repeat", F.when(F.col("_t") > 1, "formula").when(F.col("_i") > 1, "id")).drop("_t", "_i")


def new_rules_only(rules: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rules that are not stored yet, by their meaning (J-10). Rows with an external id are exempt; of equal rows in the file the first stays."""
    named = rules.filter(_blank("member_id") != "")
    rest = rules.filter(_blank("member_id") == "").join(stored.select(*key).distinct(), key, "left_anti")
    first = rest.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("row_no"))).filter("_n = 1").drop("_n")
    return named.unionByName(first.select(*named.columns))
