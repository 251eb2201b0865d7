from pyspark.sql import functions as F

from clademark.functions import alleles
from clademark.operators import indels


def annotate(spark, ref, alt, cds_pos, strand="+"):
    calls = spark.createDataFrame([(1, ref, alt, cds_pos, strand, 1)], "run_id int, ref string, alt string, cds_pos int, strand string, feature_id int")
    features = spark.createDataFrame([(1, 0, "ATGAAAGCTTAA")], "feature_id int, codon_start int, nt_sequence string")
    out = indels.annotate_indels(calls, features)
    return sorted(map(tuple, out.select("codon_pos", "ref_aa", "alt_aa", "consequence").collect()))


def test_insertion_at_a_codon_boundary(spark):
    assert annotate(spark, "G", "GTTT", 2) == [(0, "M", "MF", "insertion")]


def test_insertion_inside_a_codon_gives_exchange_and_insertion(spark):
    # AAA with TTT after its first base: ATT TAA
    assert annotate(spark, "A", "ATTT", 3) == [(1, "K", "I", "missense"), (1, "K", "K*", "insertion")]


def test_frameshift(spark):
    assert annotate(spark, "A", "AT", 3) == [(1, "K", "KfsX", "frameshift")]


def test_deletion_at_a_codon_boundary(spark):
    assert annotate(spark, "GAAA", "G", 2) == [(0, "MK", "M", "deletion")]


def test_deletion_inside_a_codon(spark):
    # A-AAG-CTT: the anchor codon becomes ACT
    assert annotate(spark, "AAAG", "A", 3) == [(1, "K", "T", "missense"), (1, "KA", "K", "deletion")]


def test_deletion_past_the_end(spark):
    assert annotate(spark, "GCTT", "G", 9) == [(3, "*", "?", "deletion")]


def test_anchor_before_the_frame_is_left_out(spark):
    assert annotate(spark, "GAAA", "G", 2, "-") == []


def test_alleles_match(spark):
    cases = [
        ("K", "fsX", "K", "KfsX", "frameshift", True), ("K", "R", "K", "KfsX", "frameshift", False),
        ("F", "INS_any", "K", "KG", "insertion", True), ("F", "FGG", "K", "KGG", "insertion", True), ("F", "FGG", "K", "KG", "insertion", False),
        ("FGG", "F", "KGG", "K", "deletion", True), ("K", "R", "Q", "R", "missense", True), (None, "R", "K", "R", "missense", True),
        ("KL", "RT", "KL", "RT", "missense", True), ("KL", "RT", "KV", "RT", "missense", False),
    ]
    x = spark.createDataFrame(cases, "r string, m string, a string, b string, c string, want boolean")
    assert x.filter(alleles.alleles_match(*map(F.col, "rmabc")) != F.col("want")).count() == 0
