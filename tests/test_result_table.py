"""The downloaded table of results, with rows worked out by hand."""

from pyspark.sql import functions as F

from clademark.operators import result_table as R

ANN = "run_id string, ann_id long, reference string, gene string, nt_mut string, nt_mut_user string, strand string, af double, depth int, consequence string, aa_effects string"
RULE = "drug string, phenotype string, clinical_phenotype string, ic50 string, fold_ic50 string, score string, source string, publications string"


def test_rows_columns_and_files(spark, tmp_path):
    ann = spark.createDataFrame([("r", i, "ref", f"g{i}", f"n{i}", f"u{i}", "+", 0.12345, 10, "missense", f"e{i}") for i in range(1, 5)] + [("q", 1, None, "h", "n", "u", "-", 1.0, None, "stop_gained", "")], ANN)
    hits = spark.createDataFrame([("r", 1, 7, "acv", "unknown", None, "2.5", "", "", "lit", "10.1/a|7"), ("r", 1, 5, "gcv", "unknown", "", "", "", "", "", "")], f"run_id string, ann_id long, rule_id long, {RULE}")
    formulas = spark.createDataFrame([("r", 3, 0.5, "acv", "", "", "", "", "3", "f", ""), ("r", 4, 0.5, "none", "", "", "", "", "", "", "")], f"run_id string, formula_id long, lower double, {RULE}")
    members = spark.createDataFrame([("r", 3, 2, 1), ("r", 3, 1, 2), ("r", 9, 1, 4)], "run_id string, formula_id long, member_no int, ann_id long")
    effects = spark.createDataFrame([("q", 1, " acv ")], "run_id string, ann_id long, drug string")
    rows = R.result_rows(ann, hits, formulas, members, effects)
    got = [tuple(x) for x in rows.orderBy(*R.KEY).select("run_id", "branch", "gene", "aa_frequency", "depth", "in_database", "rule_type", "drug", "phenotype", "ic50", "source").collect()]
    assert got == [
        ("q", 1, "h", "1.0", "", "no", "n/a", "n/a", "n/a", "", "n/a"), ("q", 3, "h", "1.0", "", "yes", "single", "acv", "resistant", "", "Metadata algorithm"),
        ("r", 1, "g1", "0.123", "10", "yes", "single", "gcv", "unknown", "", ""), ("r", 1, "g1", "0.123", "10", "yes", "single", "acv", "unknown", "2.5", "lit"),
        ("r", 1, "g2", "0.123", "10", "yes", "formula-member", "n/a", "n/a", "", "n/a"), ("r", 1, "g3", "0.123", "10", "no", "n/a", "n/a", "n/a", "", "n/a"), ("r", 1, "g4", "0.123", "10", "no", "n/a", "n/a", "n/a", "", "n/a"),
        ("r", 2, "g2;g1", "0.5", "", "yes", "formula", "acv", "", "", "f"),
    ]
    assert set(R.COLUMNS) - set(R.present_columns(rows)) == {"clinical_phenotype", "fold_ic50"}
    assert set(R.COLUMNS) - set(R.present_columns(rows.filter("run_id = 'r'"), consensus=True)) == {"clinical_phenotype", "fold_ic50", "phenotype", "reference", "nt_mut_user", "depth"}
    R.write_results_tsv(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True)
    assert back.count() == 8 and "fold_ic50" not in back.columns and back.filter("gene = 'g2;g1'").first().nt_mut == "n2;n1"
    assert R.result_rows(*(df.limit(0) for df in (ann, hits, formulas, members, effects))).count() == 0


def test_effects_of_residues(spark):
    states = "array<struct<alt_aa:string,lower:double,accepted:boolean>>"
    rows = [("N", 0.5, [("R", 0.25, True), ("N", 0.4, True), ("S", 0.0001, True), ("T", 0.9, False)], True), ("N", 0.0002, [("N", 0.4, True)], False), ("", 1.0, None, False)]
    x = spark.createDataFrame(rows, f"alt string, single double, states {states}, seen boolean")
    got = x.select(R.aa_effects(F.lit("K"), F.lit(102), F.col("alt"), F.col("single"), F.col("states"), F.col("seen")).alias("e")).collect()
    assert [y.e for y in got] == ["K103N | 0.5 | observed; K103R | 0.25 | observed", "K103N | 0.4 | lower bound", ""]
