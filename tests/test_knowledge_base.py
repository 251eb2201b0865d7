"""Metadata files, tables that fit each other, and titles, with values worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from clademark.functions import titles
from clademark.operators import knowledge
from clademark.sources import knowledge_base, settings, versions


def rows(df, *drop):
    return sorted((tuple(x) for x in df.drop("file", *drop).collect()), key=str)


def test_metadata_and_settings(spark, tmp_path):
    good = {
        "Maintainer": [" A ", "", "B"], "pmid": 123, "maintainer-update": " 2024 ", "website": None, "license": "",
        "interpretation_algorithms": [
            {"name": "drug_interpretation", "method": "by_score", "thresholds": {"Susceptible": 0, "5": 3.0}, "drug_thresholds": [{"reference": "R1", "drug": " acv ", "thresholds": {"hri": 7}}, {"drug": "gcv", "thresholds": {"resistant": 4}}]},
            {"name": "drug_interpretation", "method": "by_phenotype"},
            {"name": "effect_as_resistant", "rules": [{"feature": "tk ", "effect": ["frameshift", " stop_gained"], "reference": "R1", "drug": "acv"}]},
            {"name": "drug_groups", "groups": {"g1": ["acv", "gcv"], "g2": ["cdv"]}}, {"name": "drug_alias", "groups": {"acv": " Aciclovir "}},
        ],
    }
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    got = settings.read_metadata_json(spark, str(tmp_path / "good.json"))
    assert rows(got["problems"]) == []
    assert rows(got["metadata"]) == [("maintainer_update", "2024"), ("maintainers", "A; B"), ("publication_pmid", "123")]
    assert rows(got["thresholds"]) == [("by_score", "R1", "acv", "hri", 7.0), ("by_score", None, "gcv", "resistant", 4.0), ("by_score", None, None, "resistant", 3.0), ("by_score", None, None, "susceptible", 0.0)]
    assert rows(got["effect_rules"]) == [("tk", "frameshift", "R1", "acv"), ("tk", "stop_gained", "R1", "acv")]
    assert rows(got["drug_groups"]) == [("g1", "acv"), ("g1", "gcv"), ("g2", "cdv")] and rows(got["drug_aliases"]) == [("acv", "Aciclovir")]
    assert knowledge.check_settings(got["thresholds"].withColumnRenamed("file", "project_id")).count() == 0


def test_problems_of_metadata(spark, tmp_path):
    bad = {
        "owner": "x", "contact": 5, "pmid": "12a",
        "interpretation_algorithms": [
            {"name": "odd"}, {"name": "drug_interpretation", "method": "by_luck"}, {"name": "drug_interpretation", "method": "by_phenotype", "thresholds": {}}, {"name": "drug_interpretation", "method": "by_ic50"},
            {"name": "drug_interpretation", "method": "by_score", "thresholds": {"resistant": "3", "strange": 1}, "drug_thresholds": [{"thresholds": {"resistant": 1}}, {"drug": "d"}]}, {"name": "drug_interpretation", "method": "by_score", "thresholds": {"resistant": 1}},
            {"name": "effect_as_resistant", "rules": [{"feature": "f", "effect": ["silent"], "reference": "r", "drug": "d"}, {"feature": "f", "effect": ["insertion"], "reference": "r", "drug": "d"}, {"feature": "f"}]},
            {"name": "drug_groups", "groups": {"a": ["x"], "b": ["x"], "c": 1}}, {"name": "drug_alias", "groups": {"a": "z", "b": "z", "c": ""}}, {"name": "drug_alias", "groups": {}},
        ],
    }
    (tmp_path / "bad.json").write_text(json.dumps(bad))
    (tmp_path / "list.json").write_text("[1]")
    (tmp_path / "text.json").write_text("{not")
    got = settings.read_metadata_json(spark, [str(tmp_path / f) for f in ("bad.json", "list.json", "text.json")])
    assert rows(got["problems"]) == sorted([
        ("", "no object"), ("", "not JSON"), ("owner", "unknown key"), ("contact", "value of another kind"), ("pmid", "value of another kind"), ("0", "unknown setting"), ("1", "unknown method"), ("2", "thresholds of phenotypes"), ("3", "no thresholds"),
        ("4.resistant", "no number"), ("4.strange", "unknown label"), ("4.0", "override without drug"), ("4.1", "override without thresholds"), ("drug_interpretation by_score", "setting comes twice"), ("drug_alias", "setting comes twice"),
        ("6.0", "unknown effect"), ("6.2", "effect rule lacks a value"), ("f r d", "effect rule comes twice"), ("c", "group without drugs"), ("x", "drug comes twice"), ("c", "no alias"), ("z", "alias comes twice"), ("9", "no groups"),
    ], key=str)


def test_tables_load_together_and_broken_links_are_told(spark, tmp_path):
    tables = versions.Tables(spark, str(tmp_path / "kb"), buckets=2)
    df = lambda data, schema: spark.createDataFrame(data, schema)
    puts = {
        "reference": (df([("R1",)], "reference_name string"), None), "feature": (df([(1, "g1", "R1"), (2, "g2", "R2"), (2, None, None)], "feature_id long, name string, reference_name string"), "feature_id"),
        "segment": (df([(1, 1, 50, 60), (1, 0, 0, 9)], "feature_id long, segment_index int, start int, end int"), "feature_id"), "drug": (df([("acv",)], "drug string"), None),
        "rule": (df([(5, 1, "acv", 3, "A"), (6, 9, "gcv", 3, "A")], "rule_id long, feature_id long, drug string, position int, mutation string"), "feature_id"),
    }
    tables.commit("a", puts)
    kb = knowledge_base.load(tables)
    assert set(kb) == set(knowledge_base.CATALOG) and kb["formula"].count() == 0 and [x.has_rules for x in kb["feature"].collect()] == [False] * 3
    assert rows(knowledge_base.broken(kb)) == [("feature", "feature_id", "2", "repeated", 1), ("feature", "name", None, "missing", 1), ("feature", "reference_name", "R2", "no reference", 1), ("rule", "drug", "gcv", "no drug", 1), ("rule", "feature_id", "9", "no feature", 1)]
    assert {x.name: [tuple(s) for s in x.segments] for x in knowledge_base.with_segments(kb).collect()} == {"g1": [(0, 9), (50, 60)], "g2": [], None: []}
    # What was loaded stays that version while others write.
    tables.commit("b", {"drug": (df([("gcv",)], "drug string"), None)})
    assert kb["drug"].count() == 1 and knowledge_base.load(tables)["drug"].count() == 2 and knowledge_base.load(tables, version=1)["drug"].count() == 1
    tables.commit("c", {"publication": (df([("x",)], "key string"), None)})
    with pytest.raises(ValueError, match="publication: missing columns: publication_id"):
        knowledge_base.load(tables)


def test_titles(spark):
    given = {
        "<scp>S</scp>\n   outhern blot": "Southern blot", "<scp>U</scp>nited <scp>H</scp>3N2": "United H3N2", "An <i>In  Vitro</i> study": "An In Vitro study", "<i><scp>X</scp></i> ray": "Xray", "gene <i>UL97</i> of": "gene UL97 of",
        "a <b> open": "a open", "  plain\n text ": "plain text", "<scp>A</scp>(H1)": "A(H1)", "x<i></i>y": "x y", "<i>HSV</i>, type 1": "HSV , type 1", None: "", "2 < 3 and 4 > 1": "2 < 3 and 4 > 1",
    }
    got = spark.createDataFrame([(k,) for k in given], "t string").select("t", titles.cleaned_titles(F.col("t")).alias("c")).collect()
    assert {x.t: x.c for x in got} == given
