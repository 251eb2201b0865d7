"""Texts of reports, written out by hand."""

from clademark.operators.narrative import narrative


def test_texts_of_runs(spark):
    df = spark.createDataFrame
    runs = df([("a", "HSV"), ("b", " "), ("c", "X"), ("d", "X")], "run_id string, organism string")
    profiled = df([("a", "HSV", "tk"), ("a", "HSV", "pol"), ("a", "CMV", "UL97"), ("a", "HSV", "tk"), ("c", "X", "g")], "run_id string, organism string, feature string")
    drugs = df([("a", "Zeta", "resistant"), ("a", "acv", "susceptible"), ("a", "gcv", ""), ("c", "acv", "resistant"), ("d", "acv", None)], "run_id string, drug string, assessment string")
    labels = df([("a", "acv", "hri"), ("a", "acv", "resistant"), ("a", "gcv", "resistant"), ("a", "Zeta", "unknown"), ("a", "Zeta", "contradictory")], "run_id string, drug string, label string")
    gaps = df([("a", "tk", 3, 5), ("a", "pol", 0, 0), ("c", "g", 7, 7)], "run_id string, feature string, codon_start int, codon_end int")
    impacts = df([("a",), ("a",), ("c",)], "run_id string")
    got = {x.run_id: x for x in narrative(runs, profiled, drugs, labels, gaps, impacts).collect()}
    against = " and was evaluated against known resistance-associated mutations"
    assert got["a"].lead == f"The tested sequence information mapped to UL97 of CMV and pol and tk of HSV{against} for 2 drugs."
    assert got["b"].lead == "The tested sequence information of Unknown organism mapped to no profiled features and was evaluated, but no in-scope drugs were available for interpretation."
    assert got["c"].lead == f"The tested sequence information mapped to g of X{against} for 1 drug." and got["d"].lead.endswith(f"no profiled features{against}, but no final drug interpretation algorithm is configured.")
    assert [tuple(x) for x in got["a"].drugs] == [("hri", "Drugs assessed as hri: acv."), ("resistant", "Drugs assessed as resistant: acv and Zeta."), ("susceptible", "Drugs assessed as susceptible: acv."), ("contradictory", "Drugs assessed as contradictory: Zeta.")]
    assert got["a"].uncovered == "However, 4 positions of pol and tk could not be assessed due to incomplete sequence data." and got["c"].uncovered.startswith("However, 1 position of g ") and got["b"].uncovered == ""
    assert got["a"].high_impact == "Importantly, 2 high-impact variants were detected and require manual interpretation." and "1 high-impact variant was detected" in got["c"].high_impact and got["b"].drugs == []
