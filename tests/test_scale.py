"""What grows with the tables does not go through the driver, and work grows no faster than they do."""

import re

from clademark.operators.reads import observed_states
from clademark.plans import registry

DIR = "/root/testdata/sf0.001"
#: Tables of fixed size, projects, or a number for each feature may go to every task.
SMALL = re.compile(r"\[(alt_codon|ref_codon)#\d+\]|\[project_id#\d+L\], \[project_id#\d+L\], LeftOuter|\[feature_id#\d+L\], \[feature_id#\d+L\], LeftSemi")


def large_broadcasts(df):
    return [x for x in re.findall(r"BroadcastHashJoin .*", df._jdf.queryExecution().simpleString()) if not SMALL.search(x)]


def test_features_and_rules_are_not_broadcast(spark):
    for name in ("f6_annotate_snps", "j4_match_rules", "s14_result_rows"):
        assert not large_broadcasts(registry.QUERIES[name](spark, DIR)), name


def test_no_row_holds_the_evidence_of_a_run(spark):
    for name in ("a8_nested_formulas", "a8b_without_repeated_rules", "t6_resync_all"):
        df = registry.QUERIES[name](spark, DIR)
        assert not re.search(r"keys=\[run_id#\d+L\], functions=\[(partial_)?collect", df._jdf.queryExecution().simpleString()), name
        assert not large_broadcasts(df), name


def test_codons_with_the_same_places_are_counted_once(spark):
    reads = spark.createDataFrame([(1, "c", f"q{i}", 0, 0, 60, "4M", "ACGT") for i in range(6)], "run_id int, chrom string, qname string, flag int, pos long, mapq int, cigar string, seq string")
    places = spark.createDataFrame([(1, "c", k, "+", [1, 2]) for k in range(40)], "run_id int, chrom string, codon int, strand string, at array<bigint>")
    got = observed_states(reads, places, min_depth=5)
    assert sorted((r.codon, r.bases, r.n, r.molecules) for r in got.collect()) == [(k, "CG", 6, 6) for k in range(40)]
    assert "_places" in got._jdf.queryExecution().simpleString()


def test_lost_codons_do_not_make_the_texts_again(spark):
    plan = registry.QUERIES["c2_unassessable_codons"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    lost = [x for x in re.findall(r"filter\(sequence\(.*", plan)]
    assert lost and not any("aggregate(" in x for x in lost)


def test_a_shared_alias_is_resolved_once(spark):
    plan = registry.QUERIES["j9_resolve_rule_feature"](spark, DIR)._jdf.queryExecution().simpleString()
    assert "Window" not in plan  # over a row for each rule and feature that share a name


def test_each_codon_is_translated_once(spark):
    plan = registry.QUERIES["f1_translate_codon"](spark, DIR)._jdf.queryExecution().simpleString()
    assert re.search(r"keys=\[codon#\d+\]", plan)  # distinct codons, and not all rows, meet the code


def test_a_codon_is_found_by_its_place_in_the_sequence(spark):
    for name in ("f6_annotate_snps", "f7_annotate_indels"):
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "substring(cast(nt_sequence" in plan and "substring(nt_sequence" not in plan, name  # a text would be counted from its start


def test_gaps_are_not_listed_codon_by_codon(spark):
    plan = registry.QUERIES["w2_merge_codon_gaps"](spark, DIR)._jdf.queryExecution().simpleString()
    assert "explode(sequence(codon_start" not in plan


def test_the_matrix_reads_cells_once(spark):
    plan = registry.QUERIES["m1_mutation_matrix"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[l_orderkey", plan)) == 2  # calls for cells and for gaps


def test_indels_meet_rules_in_features_with_rules_only(spark):
    for name in ("f12_match_allele_rules", "f12b_anchor_mismatches"):
        assert "LeftSemi" in registry.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString(), name


def test_effects_are_combined_in_features_with_rules_only(spark):
    assert "LeftSemi" in registry.QUERIES["w6_match_effects"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
