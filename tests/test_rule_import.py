"""Import of rule and formula files, with outcomes worked out by hand."""

import pytest
from pyspark.sql import functions as F

from clademark.functions import sequence as S
from clademark.operators import rule_files
from clademark.sources import versions

AA = "MKTAYIAKQRQISFVKSHFSRQ"
FEATURES = "feature_id long, name string, locus_tag string, protein_id string, protein string, aa_sequence string, reference_name string, accession string, has_rules boolean"
HEAD = "feature\treference_identifier\treference\tposition\tmutation\tantiviral\trule_id\tphenotype\tic50\tscore\tcomment\tpublication\n"


@pytest.fixture
def tables(spark, tmp_path):
    out = versions.Tables(spark, str(tmp_path / "kb"), buckets=2)
    rows = [(1, "g1", "lt1", "p1", "", AA, "ref1", "acc1.1", False), (2, "g2", "g1", "", "", AA[::-1], "ref2", "acc2.1", False), (3, "g3", "", "", "", "", "ref1", "acc1.1", False)]
    out.commit("features", {"feature": (spark.createDataFrame(rows, FEATURES), "feature_id")})
    return out


def put(folder, name, head, rows):
    path = folder / name
    path.write_text(head + "".join("\t".join(r) + "\n" for r in rows))
    return str(path)


def rule(feature="g1", ref="ref1", reference="K", position="2", mutation="R", drug="acv", name="", phenotype="", ic50="", score="", comment="", publication=""):
    return (feature, ref, reference, position, mutation, drug, name, phenotype, ic50, score, comment, publication)


def told(report):
    return {(x.file.rsplit("/", 1)[-1], x.row_no, x.part): (x.severity, x.reason) for x in report.collect()}


def test_two_files_and_formulas_become_one_version(spark, tmp_path, tables):
    # The second file counts from 0; its first row is the same exchange in another feature.
    one = put(tmp_path, "one.tsv", HEAD, [
        rule(name="m1", phenotype=" Resistant ", ic50=">= 12.50 fold", publication="doi:10.1/A, PMID:7"), rule(position="3", reference="T", mutation="A", name="m2", phenotype="2"),
        rule(position="2", reference="K", mutation="R", name="m1"), rule(position="4", reference="AY", mutation="AY4S", name="x"), rule(position="5", reference="Y", mutation="YI5del", phenotype="contradictory", comment="seen"),
        rule(position="9", reference="W", mutation="A", name="m3"), rule(feature="none"), rule(ref="ref9"), rule(feature="g2"), rule(position="4", reference="A", mutation="B"),
        rule(position="7", reference="A", mutation="S"), rule(position="7", reference="A", mutation="S"), rule(position="99", reference="K"),
    ])
    two = put(tmp_path, "two.tsv", HEAD.replace("ic50", "ic_50"), [rule(feature="g2", ref="acc2.1", reference="R", position="1", mutation="K", name="n1", ic50="none", score="1e6"), rule(feature="g2", ref="ref2", reference="S", position="2", mutation="L", publication="https://doi.org/10.1/a")])
    formulas = put(tmp_path, "f.tsv", "formula_id\tantiviral\texpression\tscore\tpublication\n", [
        ("f1", "acv", "m2 and (m1 or n1)", "3", "raw text"), ("f2", "ACV", "(M1)", "", ""), ("f3", "acv", "m1 OR m1", "", ""), ("f4", "gcv", "m1 AND m3", "", ""), ("f5", "acv", "(n1 or m1) and m2", "", ""), ("f1", "gcv", "m1", "", ""),
    ])
    before = tables.read("feature")
    dry = told(rule_files.load_rule_files(tables, "b", [one, two], [formulas], dry_run=True))
    assert tables.version() == 1
    got = told(rule_files.load_rule_files(tables, "b", [one, two], [formulas]))
    assert got == dry == {
        ("one.tsv", 2, 0): ("import", ""), ("one.tsv", 3, 0): ("import", ""), ("one.tsv", 4, 0): ("skip", "repeated"), ("one.tsv", 5, 0): ("import", ""), ("one.tsv", 5, 1): ("import", ""), ("one.tsv", 6, 0): ("import", ""),
        ("one.tsv", 7, 0): ("skip", "reference mismatch"), ("one.tsv", 8, 0): ("skip", "unknown feature"), ("one.tsv", 9, 0): ("skip", "unknown reference"), ("one.tsv", 10, 0): ("skip", "feature not of reference"),
        ("one.tsv", 11, 0): ("skip", "unsupported"), ("one.tsv", 12, 0): ("import", ""), ("one.tsv", 13, 0): ("skip", "repeated"), ("one.tsv", 14, 0): ("skip", "out of range"),
        ("two.tsv", 2, 0): ("import", ""), ("two.tsv", 3, 0): ("import", ""),
        ("f.tsv", 2, 0): ("import", ""), ("f.tsv", 3, 0): ("skip", "member not imported: M1 (unknown id)"), ("f.tsv", 4, 0): ("skip", "member named twice"), ("f.tsv", 5, 0): ("skip", "member not imported: m3 (reference mismatch)"),
        ("f.tsv", 6, 0): ("skip", "repeated formula"), ("f.tsv", 7, 0): ("skip", "repeated id"),
    }
    assert tables.version() == 2 and not before.filter("has_rules").count()
    assert [x.feature_id for x in tables.read("feature").filter("has_rules").orderBy("feature_id").collect()] == [1, 2] and tables.read("feature").count() == 3
    rules = {(x.feature_id, x.position, x.reference, x.mutation): x for x in tables.read("rule").collect()}
    assert set(rules) == {(1, 1, "K", "R"), (1, 2, "T", "A"), (1, 3, "A", "S"), (1, 3, "AY", "A"), (1, 3, "AYI", "A"), (1, 6, "A", "S"), (2, 1, "R", "K"), (2, 2, "S", "L")}
    assert sorted(x.rule_id for x in rules.values()) == list(range(1, len(rules) + 1))
    first = next(x for x in rules.values() if x.member_id == "m1")
    assert (first.phenotype, first.ic50, first.score) == ("resistant", "12.5", "") and next(x for x in rules.values() if x.member_id == "n1").score == "1e+06"
    assert any(x.comment == "seen. Publications have contradictory phenotype associations." for x in rules.values())
    assert [(x.formula_id, x.canonical, x.score) for x in tables.read("formula").collect()] == [("f1", "(m2 AND (m1 OR n1))", "3")]
    ids = {x.rule_id: x.member_id for x in rules.values()}
    assert sorted(ids[x.rule_id] for x in tables.read("formula_member").collect()) == ["m1", "m2", "n1"]
    assert sorted(x.key for x in tables.read("publication").collect()) == ["10.1/a", "pmid:7", "raw text"]
    assert tables.read("rule_publication").count() == 3 and tables.read("formula_publication").count() == 1
    # The same batch again changes nothing; the same rules in another batch are there already.
    rule_files.load_rule_files(tables, "b", [one, two], [formulas])
    assert tables.version() == 2
    third = put(tmp_path, "three.tsv", HEAD, [rule(position="7", reference="A", mutation="S"), rule(position="7", reference="A", mutation="T"), rule(position="7", reference="A", mutation="T", drug="gcv")])
    again = told(rule_files.load_rule_files(tables, "c", [third]))
    assert again == {("three.tsv", 2, 0): ("skip", "stored"), ("three.tsv", 3, 0): ("import", ""), ("three.tsv", 4, 0): ("import", "")}
    assert sorted(x.rule_id for x in tables.read("rule").collect()) == list(range(1, len(rules) + 3)) and sorted(x.drug for x in tables.read("drug").collect()) == ["acv", "gcv"]


def test_one_error_leaves_the_import_out(spark, tmp_path, tables):
    good = rule()
    wrong = {
        "no reference_identifier": rule(ref=""), "no reference": rule(reference=""), "reserved id": rule(name="And"), "no drug": rule(drug=""), "no position or mutation": rule(mutation=""), "invalid position": rule(position="x"),
        "no sequence": rule(feature="g3", mutation="K2del"), "no anchor": rule(position="2", mutation="W2del"), "invalid ic50": rule(ic50="much"), "invalid score": rule(score="1 2"), "invalid phenotype": rule(phenotype="odd"),
        "unrecognised": rule(mutation="del"), "position conflict": rule(mutation="K5KGG"), "no change": rule(mutation="k"), "id conflict": rule(name="a", mutation="S"),
    }
    path = put(tmp_path, "bad.tsv", HEAD, [good, rule(name="a"), *wrong.values()])
    got = told(rule_files.load_rule_files(tables, "b", [path]))
    assert [got["bad.tsv", i + 4, 0] for i in range(len(wrong))] == [("error", r) for r in wrong]
    assert tables.version() == 1 and not tables.has("rule")
    head = put(tmp_path, "head.tsv", HEAD.replace("score", "ic_50"), [good])
    assert ("error", "several columns of ic50") in told(rule_files.load_rule_files(tables, "b", [head])).values() and tables.version() == 1
    # Parts of formulas may lack a drug where ids are required; an id must not come back in a later file.
    part = put(tmp_path, "part.tsv", HEAD, [rule(drug="", name="p1")])
    assert told(rule_files.load_rule_files(tables, "b", [part], require_ids=True)) == {("part.tsv", 2, 0): ("import", "")}
    assert told(rule_files.load_rule_files(tables, "c", [part], require_ids=True)) == {("part.tsv", 2, 0): ("error", "id exists")}
    bad = put(tmp_path, "f.tsv", "group_id\tantiviral\tformula\tic50\n", [("", "d", "p1", ""), ("f", "", "p1", ""), ("f", "d", "", ""), ("or", "d", "p1", ""), ("f", "d", "p1 and", ""), ("g", "d", "p1", "x")])
    empty = put(tmp_path, "empty.tsv", HEAD, [])
    found = told(rule_files.load_rule_files(tables, "d", [empty], [bad]))
    assert [found["f.tsv", i, 0][1] for i in range(2, 8)] == ["no formula_id", "no drug", "no expression", "reserved id", "invalid expression", "invalid ic50"]


def test_values_as_stored(spark):
    given = ["", None, "none", ">= 0.00001234567", "12.50x", "1234567", "-3", "0", "100", "abc", "1e300", ".5"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", S.number_in(F.col("t")).alias("v")).orderBy("i").collect()
    assert [x.v for x in got] == ["", "", "", "1.23457e-05", "12.5", "1.23457e+06", "-3", "0", "100", None, "1e+300", "0.5"]
    labels = [" HRI", "none", "unknown", "5", "03", "0", "odd", "conflicting", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(labels)], "i int, t string").select(S.phenotype_label(F.col("t")).alias("v"), "i").orderBy("i").collect()
    assert [x.v for x in got] == ["hri", "unknown", "unknown", "resistant", "low-level resistance", None, None, "conflicting", ""]
