"""Reference genomes from flat files, with features worked out by hand."""

from pyspark.sql import functions as F

from clademark.sources import genbank

#         1234567890123456789012345678901234567890123456789012345678901234567890
GENOME = "atgaaaacagcatattaa" + "ttatgcatgttccat" + "gggcccaaatttgggccc" + "atgtgtuaa"


def record(locus="L1", version="A1.2", accession="A1 A9", features="", genome=GENOME):
    lines = [f"LOCUS       {locus}  60 bp    DNA", f"ACCESSION   {accession}", f"VERSION     {version}", "SOURCE      x", "  ORGANISM  Test virus 1", "            Viruses; Duplodnaviria;", "            Herpesvirales.", "FEATURES             Location/Qualifiers", '     source          1..60', '                     /organism="other"']
    origin = [f"{i + 1:9d} {genome[i:i + 10]} {genome[i + 10:i + 20]}" for i in range(0, len(genome), 20)]
    return "\n".join([*lines, *features.strip("\n").split("\n"), "ORIGIN", *origin, "//", ""])


def feature(kind, location, *qualifiers):
    return "\n".join([f"     {kind:<16}{location}", *[f"                     {q}" for q in qualifiers], ""])


def read(spark, tmp_path, *texts):
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.gb").write_text(t)
    return genbank.read_genbank(spark, [str(tmp_path / f"{i}.gb") for i in range(len(texts))])


def test_records_features_and_segments(spark, tmp_path):
    made = feature("gene", "1..18", '/gene="g1"')
    made += feature("CDS", "1..18", '/gene="g1"', '/product="long', 'name with ""quotes""', '/x.gb"', '/note="a/b"', '/protein_id="p1"', "/codon_start=1")
    made += feature("CDS", "complement(19..33)", '/locus_tag="lt2"')
    made += feature("CDS", "1..18", '/gene="g1"', '/note="again"')
    made += feature("CDS", "join(1..3,", "52..>60)", '/protein_id="p3"', '/translation="MM', 'C*"')
    made += feature("CDS", "complement(join(28..33,19..21))", '/product="turned"', "/pseudo")
    made += feature("CDS", "join(complement(31..33),complement(19..21))", '/gene="parts"')
    made += feature("mat_peptide", "4..9", '/product="g1"') + feature("mat_peptide", "10..15", '/product="g1"') + feature("mat_peptide", "7..9", '/gene="g1_2"')
    made += feature("mat_peptide", "complement(22..24)", "/codon_start=2") + feature("mat_peptide", "35..40")
    refs, features, segments, problems = read(spark, tmp_path, record(features=made) + record("L2", "", "B1", feature("CDS", "1..6", '/gene="g1"').rstrip()))
    assert sorted(tuple(x) for x in refs.drop("sequence").collect()) == [("A1.2", "A1", 60, "Test virus 1", "Viruses; Duplodnaviria; Herpesvirales"), ("B1", "B1", 60, "Test virus 1", "Viruses; Duplodnaviria; Herpesvirales")]
    assert {x.sequence for x in refs.collect()} == {GENOME.upper()}
    rows = {x.name: x for x in features.filter("reference_name = 'A1.2'").collect()}
    assert sorted((x.feature_no, x.name) for x in rows.values()) == [(3, "g1"), (4, "lt2"), (6, "p3"), (7, "turned"), (8, "parts"), (9, "g1_2"), (10, "g1_3"), (11, "g1_2_2"), (12, "lt2_mat_peptide_4"), (13, "p3_mat_peptide_5")]
    g1, lt2 = rows["g1"], rows["lt2"]
    assert (g1.protein, g1.note, g1.protein_id, g1.strand, g1.start, g1.end, g1.codon_start) == ('long name with "quotes" /x.gb', "a/b", "p1", "+", 0, 18, 0)
    assert (g1.nt_sequence, g1.aa_sequence, g1.feature_type, g1.parent_name) == ("ATGAAAACAGCATATTAA", "MKTAY", "CDS", "")
    assert (lt2.nt_sequence, lt2.aa_sequence, lt2.strand, lt2.protein) == ("ATGGAACATGCATAA", "MEHA", "-", "lt2")
    assert (rows["p3"].nt_sequence, rows["p3"].aa_sequence, rows["p3"].start, rows["p3"].end) == ("ATGATGTGTTAA", "MMC", 0, 60)
    assert rows["turned"].nt_sequence == "TAAATGGAA" and rows["parts"].nt_sequence == "ATGTAA"
    assert [rows[n].parent_name for n in ("g1_2", "g1_3", "g1_2_2", "lt2_mat_peptide_4", "p3_mat_peptide_5")] == ["g1", "g1", "g1", "lt2", "p3"]
    parts = {}
    for x in segments.filter("reference_name = 'A1.2'").orderBy("name", "segment_index").collect():
        parts.setdefault(x.name, []).append((x.start, x.end))
    assert parts["p3"] == [(0, 3), (51, 60)] and parts["turned"] == [(18, 21), (27, 33)] and parts["parts"] == [(30, 33), (18, 21)] and len(parts) == 10
    assert [tuple(x) for x in problems.collect()] == [("A1.2", "turned", "stop inside")]
    assert [x.aa_sequence for x in features.filter("reference_name = 'B1'").collect()] == ["MK"]


def test_problems(spark, tmp_path):
    bad = feature("CDS", "1..18", "/pseudo") + feature("CDS", "one-of(1,4)..9", '/gene="odd"') + feature("CDS", "1..6", '/gene="s"', '/translation="M*K"')
    *_, problems = read(spark, tmp_path, record(features=bad), record(genome=""), record("", "", "", genome="acgt").replace("LOCUS         60 bp    DNA", "LOCUS"))
    assert sorted(tuple(x) for x in problems.collect()) == [("", "", "no id"), ("A1.2", "", "accession comes again"), ("A1.2", "", "id comes again"), ("A1.2", "", "no name"), ("A1.2", "", "no sequence"), ("A1.2", "odd", "unknown location"), ("A1.2", "s", "stop inside")]


def test_locations(spark):
    given = {"7": [(6, 7, 1)], "3..5": [(2, 5, 1)], "<3..>5": [(2, 5, 1)], "complement(3..5)": [(2, 5, -1)], "J1.2:3..5": [(2, 5, 1)], "3^4": [(2, 4, 1)], "order(1..2,complement(4..5))": [(0, 2, 1), (3, 5, -1)], "complement(order(1..2,4..5))": [(3, 5, -1), (0, 2, -1)], "gap(5)": []}
    got = spark.createDataFrame([(x,) for x in given], "x string").select("x", genbank.location_parts(F.col("x")).alias("p")).collect()
    assert {x.x: [tuple(p) for p in x.p] for x in got} == given
