"""Import of rules and formulas from files to the tables of a knowledge base, as one step that happens or does not.

All rows go through all steps at once. A step gives each row it stops a severity and a reason; of several the first counts. Rows that a step ``skip``s are left out, one ``error`` leaves
the whole import out. What stays is numbered, joined with what is stored and committed as one version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..sources import files
from ..sources.versions import Tables
from . import kb_import, report
from .formulas import BINDS, compiled
from .ranks import numbered
from .rules import COMPONENT_DRUG

RULE_ALIASES = {"member_id": ["rule_id"], "ic50": ["ic_50"], "fold_ic50": ["fold_ic_50"]}
FORMULA_ALIASES = {"formula_id": ["group_id"], "expression": ["formula"], "ic50": ["ic_50"], "fold_ic50": ["fold_ic_50"]}
#: Of these a file may have one each.
ONE_OF = (("ic50", "ic_50"), ("fold_ic50", "fold_ic_50"))
_SHARED = ["antiviral", "phenotype", "clinical_phenotype", "ic50", "fold_ic50", "score", "source", "comment", "publication"]
RULE_COLUMNS = ["feature", "reference_identifier", "reference", "position", "mutation", "member_id", *_SHARED]
FORMULA_COLUMNS = ["formula_id", "expression", "label", *_SHARED]
#: What tells stored rules without an id apart.
RULE_KEY = ["feature_id", "drug", "reference_identifier", "position", "reference", "mutation"]
_VALUES = ["phenotype", "clinical_phenotype", "ic50", "fold_ic50", "score"]
REPORT = "kind string, file string, row_no long, part int, name string, severity string, reason string"


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _completed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all of the columns, as trimmed texts."""
    have = {c: _text(c) if c in rows.columns else F.lit("") for c in columns}
    return rows.select(F.col("file").cast("string").alias("file"), F.col("row_no").cast("long").alias("row_no"), *[v.alias(c) for c, v in have.items()])


def _value_steps(x: DataFrame) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """Values as stored (F-20, F-21) beside what is written, and the errors of those that are none."""
    made = {"ic50": S.number_in, "fold_ic50": S.number_in, "score": S.number_as_stored, "phenotype": S.phenotype_label, "clinical_phenotype": S.phenotype_label}
    x = x.withColumns({f"_{c}": f(F.col(c)) for c, f in made.items()})
    return x, [(f"invalid {c}", F.col(f"_{c}").isNull()) for c in made]


def _first(steps: list[tuple[str, str, Column]]) -> Column:
    """``severity, reason`` of the first step that stops a row; null if none does."""
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("reason"))) for s, r, c in steps]
    return F.coalesce(*found)


def checked_rules(rules: DataFrame, features: DataFrame, stored: DataFrame | None = None, require_ids: bool = False) -> DataFrame:
    """Rule rows as they would be stored, each with ``severity`` and ``reason`` (T-2, A-31).

    ``rules``: ``file, row_no`` and columns of ``RULE_COLUMNS``, as texts. ``features``: ``feature_id, name, locus_tag, protein_id, protein, aa_sequence, reference_name, accession``. ``stored``: rules that are there.
    A row that exchanges its anchor becomes two, told apart by ``part`` (F-10). ``severity`` is ``error``, ``skip``, ``note`` (stored, with a remark) or ``import``.

    Each file counts positions from 1 or 0 for itself. An id may be defined once in all files together: an equal definition loses it (note), another one is an error, as is an id that is stored.
    Rows without id that are stored already, or come again, are skipped. With ``require_ids`` a rule with id may lack its drug: it is then part of formulas only.
    """
    x = _completed(rules, RULE_COLUMNS)
    # Rows of several files may have one number: what tells rows apart is file, number and part.
    x = x.withColumn("_written", F.col("mutation"))
    x = kb_import.split_anchor_changed(x, by="file").withColumn("part", F.when(F.col("member_id").endswith("__indel") & (F.col("mutation") != F.col("_written")), 1).otherwise(0))
    x = x.withColumnRenamed("row_no", "_line").withColumn("row_no", F.struct("file", F.col("_line").alias("row_no"), "part"))
    x = kb_import.resolve_rule_feature(x, features)
    names = features.select(F.explode(F.array(*map(_text, ("name", "locus_tag", "protein_id", "protein")))).alias("feature")).filter("feature <> ''").distinct().withColumn("_named", F.lit(True))
    places = features.select(F.explode(F.array("reference_name", "accession")).alias("reference_identifier")).filter("reference_identifier <> ''").distinct().withColumn("_placed", F.lit(True))
    x = x.join(names, "feature", "left").join(places, "reference_identifier", "left")
    base = kb_import.detect_coordinate_base(x)
    x = kb_import.validate_reference_aa(x, base).join(F.broadcast(base.select("file", "base")), "file", "left")

    # F-11: a deletion without anchor gets that of the protein.
    at = F.col("position").try_cast("int") - F.coalesce("base", F.lit(1))
    block = F.regexp_extract("mutation", r"(?i)^([A-Z]+)\d+DEL$", 1)
    x = x.withColumns({"_at": at, "_block": block}).withColumn("_found", F.when(F.col("_block") != "", kb_import.resolve_anchorless_deletion(F.col("_block"), F.col("_at"), F.coalesce("aa_sequence", F.lit("")))))
    place = {c: F.coalesce(F.col(f"_found.{c}"), F.col(old)) for c, old in (("position", "_at"), ("reference", "reference"), ("mutation", "mutation"))}
    x = x.withColumns({f"_p_{c}": v for c, v in place.items()}).withColumn("_a", kb_import.rule_alleles(F.col("_p_reference"), F.col("_p_mutation"), F.col("_p_position")))
    x, values = _value_steps(x)
    taken = _taken(stored, "member_id", "_taken")
    x = x.join(taken, F.col("member_id") == F.col("_taken"), "left")

    blank = lambda c: F.col(c) == ""
    known_drug = ~blank("antiviral") | (F.lit(require_ids) & ~blank("member_id"))
    wrong = F.col("_a.problem")
    steps = [
        ("error", "no reference_identifier", blank("reference_identifier")), ("error", "no reference", blank("reference")),
        ("error", "reserved id", F.upper("member_id").isin(*BINDS)), ("error", "id exists", F.col("_taken").isNotNull() & ~blank("member_id")),
        ("error", "coordinates", F.col("base").isNull()),
        ("skip", "unknown reference", F.col("_placed").isNull()), ("skip", "unknown feature", F.col("_named").isNull()), ("skip", "feature not of reference", F.col("problem").isNotNull()),
        ("error", "no drug", ~known_drug), ("error", "no position or mutation", blank("position") | blank("mutation")), ("error", "invalid position", F.col("_at").isNull()),
        ("skip", "out of range", F.col("skip") == "out of range"), ("skip", "reference mismatch", F.col("skip") == "reference mismatch"),
        ("error", "no sequence", ~blank("_block") & (F.coalesce("aa_sequence", F.lit("")) == "")), ("error", "no anchor", ~blank("_block") & F.col("_found").isNull()),
        *[("error", reason, c) for reason, c in values],
        ("error", "unrecognised", wrong.isin("unrecognised", "blank")), ("error", "position conflict", wrong == "position conflict"), ("error", "no change", wrong == "no change"), ("skip", "unsupported", wrong == "unsupported"),
    ]
    drug = F.when(~blank("antiviral"), F.col("antiviral")).otherwise(COMPONENT_DRUG).alias("drug")
    comment = kb_import.contradictory_comment(F.col("comment"), F.col("_phenotype"), F.col("_clinical_phenotype")).alias("comment")
    stay = ["row_no", "member_id", "feature_id", "reference_identifier", "source", "publication"]
    x = x.select(*stay, drug, comment, *[F.col(f"_a.{c}").alias(c) for c in ("position", "reference", "mutation")], *[F.col(f"_{c}").alias(c) for c in _VALUES], F.col("member_id").alias("name"), _first(steps).alias("_stop"))

    # Repeated ids and repeated rules, among what the steps before let through.
    good = kb_import.first_definition(x.filter("_stop is null"), ["feature_id", "reference_identifier", "position", "reference", "mutation"])
    conflict = F.coalesce(F.col("repeat") == "conflict", F.lit(False))
    good = good.withColumn("_stop", F.when(conflict, F.struct(F.lit("error").alias("severity"), F.lit("id conflict").alias("reason"))))
    free = (F.col("member_id") == "") & ~conflict
    # Ids keep a rule that comes again; one without is a repetition of any before it.
    again = F.row_number().over(W.partitionBy(conflict, *RULE_KEY).orderBy("row_no")) > 1
    there = stored.select(*RULE_KEY).distinct().withColumn("_there", F.lit(True)) if stored is not None else None
    good = good.join(there, RULE_KEY, "left") if there is not None else good.withColumn("_there", F.lit(None).cast("boolean"))
    late = F.when(free & F.col("_there").isNotNull(), "stored").when(free & again, "repeated")
    good = good.withColumn("_stop", F.coalesce("_stop", F.when(late.isNotNull(), F.struct(F.lit("skip").alias("severity"), late.alias("reason"))), F.when(F.col("repeat") == "stripped", F.struct(F.lit("note").alias("severity"), F.lit("id stripped").alias("reason")))))
    x = good.select(*x.columns).unionByName(x.filter("_stop is not null"))
    return x.select("row_no.*", "name", F.coalesce("_stop.severity", F.lit("import")).alias("severity"), F.coalesce("_stop.reason", F.lit("")).alias("reason"), *[c for c in x.columns if c not in ("row_no", "name", "_stop")])


def _taken(stored: DataFrame | None, c: str, name: str) -> DataFrame:
    from pyspark.sql import SparkSession

    if stored is None:
        return SparkSession.active().createDataFrame([], f"{name} string")
    return stored.select(F.col(c).alias(name)).filter(F.col(name) != "").distinct()


def checked_formulas(formulas: DataFrame, rules: DataFrame, stored_rules: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Formula rows as they would be stored, each with ``severity`` and ``reason``, and in ``atoms`` the ids of their members.

    ``rules``: what ``checked_rules`` gives. A formula with a member that is not imported is skipped with the reasons of its members; so are one that names a member twice and a repeated one (W-4b). A
    formula that does not parse, or whose id or text (of its drug) is stored, is an error.
    """
    x = compiled(_completed(formulas, FORMULA_COLUMNS)).withColumnRenamed("problem", "_problem").withColumnRenamed("antiviral", "drug")
    x, values = _value_steps(x)
    blank = lambda c: F.col(c) == ""
    early = [
        ("error", "no formula_id", blank("formula_id")), ("error", "no drug", blank("drug")), ("error", "no expression", blank("expression")), ("error", "reserved id", F.upper("formula_id").isin(*BINDS)),
        ("error", "invalid expression", F.col("_problem").isNotNull()), ("skip", "member named twice", F.size(F.array_distinct("atoms")) < F.size("atoms")),
    ]
    x = x.withColumn("_stop", _first(early)).withColumn("_line", F.col("row_no")).withColumn("row_no", F.struct("file", "_line"))
    good = kb_import.dedupe_formulas(x.filter("_stop is null"))
    x = good.unionByName(x.filter("_stop is not null").withColumn("repeat", F.lit(None).cast("string")))

    # Members: ids that are stored or will be, and why others are not.
    own = rules.filter("name <> ''").groupBy(F.col("name").alias("_m")).agg(F.max(F.col("severity").isin("import", "note") & (F.col("member_id") != "")).alias("_in"), F.min(F.when(F.col("severity").isin("skip", "error"), F.col("reason"))).alias("_why"))
    there = _taken(stored_rules, "member_id", "_m").withColumn("_old", F.lit(True))
    m = x.filter("_stop is null and repeat is null").select("row_no", F.explode("atoms").alias("_m")).join(own, "_m", "left").join(there, "_m", "left")
    m = m.filter(~(F.coalesce("_in", F.lit(False)) | F.coalesce("_old", F.lit(False))))
    lacks = m.groupBy("row_no").agg(F.array_join(F.array_sort(F.collect_list(F.concat("_m", F.lit(" ("), F.coalesce("_why", F.lit("unknown id")), F.lit(")")))), ", ").alias("_lacks"))
    x = x.join(lacks, "row_no", "left")
    ids = _taken(stored, "formula_id", "_taken")
    x = x.join(ids, F.col("formula_id") == F.col("_taken"), "left")
    texts = stored.select(F.col("drug").alias("_d"), F.col("canonical").alias("_t")).distinct() if stored is not None else _taken(None, "", "_d").withColumn("_t", F.col("_d"))
    x = x.join(texts, (F.col("drug") == F.col("_d")) & (F.col("canonical") == F.col("_t")), "left")
    late = [
        ("skip", "repeated formula", F.col("repeat") == "formula"), ("skip", "repeated id", F.col("repeat") == "id"), ("skip", "member not imported", F.col("_lacks").isNotNull()),
        *[("error", r, c) for r, c in values], ("error", "id exists", F.col("_taken").isNotNull()), ("error", "formula exists", F.col("_t").isNotNull()),
    ]
    stop = F.coalesce("_stop", _first(late))
    comment = kb_import.contradictory_comment(F.col("comment"), F.col("_phenotype"), F.col("_clinical_phenotype")).alias("comment")
    kept = ["formula_id", "drug", "label", "canonical", "postfix", "atoms", "source", "publication"]
    return x.select("file", F.col("_line").alias("row_no"), F.lit(0).alias("part"), F.col("formula_id").alias("name"), F.coalesce(stop["severity"], F.lit("import")).alias("severity"), F.coalesce(stop["reason"], F.lit("")).alias("reason"), F.col("_lacks").alias("lacks"), *kept, comment, *[F.col(f"_{c}").alias(c) for c in _VALUES])


def import_report(rules: DataFrame, formulas: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """A row for each row of the files: ``REPORT`` (A-31). A formula's missing members are in its reason."""
    names = [c.split()[0] for c in REPORT.split(", ")]
    out = rules.withColumn("kind", F.lit("rule")).select(*names)
    if formulas is not None:
        reason = F.when(F.col("lacks").isNotNull() & (F.col("reason") == "member not imported"), F.concat("reason", F.lit(": "), "lacks")).otherwise(F.col("reason"))
        out = out.unionByName(formulas.withColumn("kind", F.lit("formula")).withColumn("reason", reason).select(*names))
    return out if headers is None else out.unionByName(headers.select(*names))


def report_counts(rows: DataFrame) -> DataFrame:
    """Rows of each file by outcome and reason (A-31)."""
    return rows.groupBy("kind", "file", "severity", F.regexp_replace("reason", ":.*$", "").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_rule_files(tables: Tables, paths: list[str], aliases: dict[str, list[str]]) -> tuple[DataFrame | None, DataFrame]:
    """(rows of the files, the errors of their headers) (S-5, S-6)."""
    spark, all_, wrong = tables.spark, None, []
    for path in paths:
        rows, columns = files.read_numbered_tsv(spark, path, aliases)
        wrong += [("header", path, 1, 0, "", "error", f"several columns of {pair[0]}") for pair in ONE_OF if set(pair) <= set(columns)]
        all_ = rows if all_ is None else all_.unionByName(rows, allowMissingColumns=True)
    return all_, spark.createDataFrame(wrong, REPORT)


def _stored(tables: Tables, name: str) -> DataFrame | None:
    return tables.read(name) if tables.has(name) else None


def _with_ids(rows: DataFrame, stored: DataFrame | None, name: str, order: list[str]) -> DataFrame:
    """Numbers that go on from the largest stored one (O-1)."""
    last = stored.agg(F.max(name)).first()[0] if stored is not None else None
    return numbered(rows, order, name, start=(last or 0) + 1)


def _cited(rows: DataFrame, of: str) -> DataFrame:
    """The publications that rows name: their id and the publication's ``key``, its DOI, else its PubMed id, else the text."""
    x = report.publications(rows.select(of, "publication"))
    return x.withColumn("key", F.when(F.col("doi") != "", F.lower("doi")).when(F.col("pmid") != "", F.concat(F.lit("pmid:"), "pmid")).otherwise(F.col("raw")))


def load_rule_files(tables: Tables, batch: str, rule_paths: list[str], formula_paths: list[str] | None = None, require_ids: bool = False, dry_run: bool = False) -> DataFrame:
    """Import rule and formula files into a knowledge base; the report of ``import_report`` (T-2).

    ``tables`` has ``feature`` (see ``checked_rules``); ``rule``, ``formula``, ``formula_member``, ``drug``, ``publication``, ``rule_publication`` and ``formula_publication`` are made if they are missing. If any row is
    an error, or with ``dry_run``, nothing is written. Else one version has all of it: rules and formulas with their ids, members, drugs that are new, publications and their
    links, and features with rules marked (P-3). A batch that is there already is not imported again.
    """
    features, old, old_formulas = tables.read("feature"), _stored(tables, "rule"), _stored(tables, "formula")
    raw, headers = read_rule_files(tables, rule_paths, RULE_ALIASES)
    rules = tables.staged(checked_rules(raw, features, old, require_ids))
    formulas = None
    if formula_paths:
        raw, more = read_rule_files(tables, formula_paths, FORMULA_ALIASES)
        headers, formulas = headers.unionByName(more), tables.staged(checked_formulas(raw, rules, old, old_formulas))
    found = import_report(rules, formulas, headers)
    if dry_run or not found.filter("severity = 'error'").isEmpty() or batch in tables.manifest()["batches"]:
        return found
    fine = F.col("severity").isin("import", "note")
    new = _with_ids(rules.filter(fine), old, "rule_id", ["file", "row_no", "part"])
    stored = ["rule_id", "feature_id", "drug", "member_id", "reference_identifier", "position", "reference", "mutation", *_VALUES, "source", "comment"]
    puts = {"rule": (new.select(*stored), "feature_id")}
    drugs, cited, links = new.select("drug"), _cited(new, "rule_id"), {"rule": _cited(new, "rule_id")}
    if formulas is not None:
        more = _with_ids(formulas.filter(fine), old_formulas, "formula_no", ["file", "row_no"])
        puts["formula"] = (more.select("formula_no", "formula_id", "drug", "label", "canonical", "postfix", "atoms", *_VALUES, "source", "comment"), "formula_no")
        ids = new.filter("member_id <> ''").select("member_id", "rule_id")
        ids = ids if old is None else ids.unionByName(old.filter("member_id <> ''").select("member_id", "rule_id"))
        puts["formula_member"] = (more.select("formula_no", F.explode("atoms").alias("member_id")).join(ids, "member_id").select("formula_no", "rule_id"), "formula_no")
        drugs, links["formula"] = drugs.unionByName(more.select("drug")), _cited(more, "formula_no")
        cited = cited.select("key", "doi", "pmid", "raw").unionByName(links["formula"].select("key", "doi", "pmid", "raw"))
    before = _stored(tables, "drug")
    drugs = drugs.distinct() if before is None else drugs.distinct().join(before, "drug", "left_anti")
    before, known = _stored(tables, "publication"), cited.groupBy("key").agg(F.max("doi").alias("doi"), F.max("pmid").alias("pmid"), F.min("raw").alias("raw"))
    known = known if before is None else known.join(before, "key", "left_anti")
    known = _with_ids(known, before, "publication_id", ["key"])
    every = known if before is None else known.unionByName(before.select(*known.columns))
    puts |= {"drug": (drugs, "drug"), "publication": (known, "publication_id")}
    for kind, of in (("rule", "rule_id"), ("formula", "formula_no")):
        if kind in links:
            puts[f"{kind}_publication"] = (links[kind].join(every.select("key", "publication_id"), "key").select(of, "publication_id").distinct(), of)
    marked = features.join(new.select("feature_id").distinct(), "feature_id", "left_semi").withColumn("has_rules", F.lit(True))
    puts["feature"] = (marked, "feature_id")
    tables.commit(batch, puts, {"feature": (marked.select("feature_id"), ["feature_id"])})
    return found
