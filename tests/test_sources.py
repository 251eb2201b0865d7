"""Scans and stores on small files with values worked out by hand."""

import datetime

import pytest

from clademark.operators import codon, combined, formulas, knowledge, ranks
from clademark.sources import files, store, versions
from clademark.streaming import ingest


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_vcf(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"
    rows = [
        "ref\t4\t.\ta\tG\t.\tPASS\tAF=0.95;DP=500",
        "ref\t10\t.\tT\tC,<DEL>,*\t.\t.\tAF=0.25,.,.;DP=200",
        "ref\t12\t.\tU\tA,C\t.\tq\t.\tGT:AD\t0/1:50,30,20",
        "ref\t13\t.\tG\tA\t.\tq\tFREQ=12.5%\t.\t.",
        "ref\t14\t.\tG\tA[ref:1[\t.\tq\tAF=1\t.\t.",
    ]
    got = sorted(tuple(x) for x in files.read_vcf(spark, put(tmp_path, "s1.vcf", head + "\n".join(rows) + "\n")).select("run_id", "pos", "ref", "alt", "filter", "af", "depth").collect())
    assert got == [
        ("s1", 3, "A", "G", "PASS", 0.95, 500), ("s1", 9, "T", "C", ".", 0.25, 200),
        ("s1", 11, "T", "A", "q", 0.3, 100), ("s1", 11, "T", "C", "q", 0.2, 100), ("s1", 12, "G", "A", "q", 0.125, -1),
    ]
    calls = files.read_vcf(spark, str(tmp_path / "s1.vcf"))
    assert [tuple(x) for x in files.vcf_contigs(calls).collect()] == [("s1", "ref")]


def test_fasta_keeps_the_last_record_of_an_id(spark, tmp_path):
    path = put(tmp_path, "a.fasta", ">one first words\nacgu\nNNA\n>two\nTTNN\n>one again\nGG\nNN\n")
    assert {x.id: x.sequence for x in files.read_fasta(spark, path).collect()} == {"one": "GG", "two": "TT"}


def test_paf_keeps_the_first_primary_hit(spark, tmp_path):
    row = lambda start, kind: f"q\t100\t{start}\t90\t+\tgag\t90\t0\t90\t80\t100\t60\ttp:A:{kind}\tcg:Z:90M\n"
    got = files.read_alignments(spark, put(tmp_path, "a.paf", row(1, "S") + row(2, "P") + row(3, "P"))).collect()
    assert [(x.query, x.feature, x.query_start, x.identity, x.cigar) for x in got] == [("q", "gag", 2, 0.8, "90M")]


def test_sam_and_tables(spark, tmp_path):
    got = files.read_sam(spark, put(tmp_path, "a.sam", "@HD\tVN:1.6\nr1\t99\tref\t5\t60\t4M\t=\t9\t8\tACGT\tIIII\n")).collect()
    assert [(x.qname, x.flag, x.chrom, x.pos, x.mapq, x.cigar, x.seq) for x in got] == [("r1", 99, "ref", 4, 60, "4M", "ACGT")]
    table = files.read_tsv(spark, put(tmp_path, "r.tsv", "feature\trule_id\tic_50\ngag\tm1\t 4 \npol\t\t\n"), {"member_id": ["rule_id"], "ic50": ["ic_50"]})
    assert [(x.feature, x.member_id, x.ic50) for x in table.collect()] == [("gag", "m1", "4"), ("pol", None, None)]
    files.write_clean_tsv(spark.createDataFrame([("a\tb\nc", 1)], "t string, n int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()[0].t == "a b c"


def test_result_documents_round_trip(spark, tmp_path):
    when = datetime.datetime(2026, 1, 2, 3, 4, 5)
    runs = spark.createDataFrame([("r1", "p", "u", "s1", "ref", when, "done"), ("r2", "p", "u", "s2", "ref", when, "done")], store.RUN)
    variants = spark.createDataFrame([("r1", 1, 5, "K", "E", "missense", 0.5), ("r1", 1, 2, "A", "V", "missense", 1.0)], f"run_id string, {store.VARIANT}")
    gaps = spark.createDataFrame([("r2", 1, 3, 9)], f"run_id string, {store.GAP}")
    store.write_run_json(store.run_documents(runs, variants, gaps), str(tmp_path / "docs"))
    put(tmp_path / "docs", "extra.txt", '{"run": {"sample_name": "x"}}\n{"run": {"run_id": "r3"}, "variant_result": []}\n')
    back, v, g, rejected = store.read_run_json(spark, str(tmp_path / "docs"))
    key = lambda df: sorted(tuple(x) for x in df.collect())
    assert key(back.select(runs.columns)) == key(runs) and key(v.select(variants.columns)) == key(variants) and key(g.select(gaps.columns)) == key(gaps)
    assert sorted(x.lacks for x in rejected.collect()) == ["coverage_gap", "run"]
    new = runs.filter("run_id = 'r2'").selectExpr("run_id", "project_id", "project_uuid", "sample_name", "reference_name", "created_at", "'failed' as status")
    assert key(store.upsert(runs, new, ["run_id"]).select("run_id", "status")) == [("r1", "done"), ("r2", "failed")]


def test_full_documents_round_trip(spark, tmp_path):
    when = datetime.datetime(2026, 1, 2, 3, 4, 5)
    df = spark.createDataFrame
    runs = df([("r1", "p", "u", "s1", "ref", when, "done"), ("r2", "q", "u", "s2", "ref", when, "done")], store.RUN)
    lists = {
        "variant_result": [("r1", 1, 2, "A", "V", "missense", 1.0)], "coverage_gap": [("r2", 1, 3, 9)], "formula_rule_hit": [("r1", "f2", "acv", 0.5, "m1,m2"), ("r1", "f1", None, 0.25, "")],
        "profiled_feature": [("r1", "ref", "tk"), ("r2", "ref", "pol")], "setting": [("p", "by_score", None, "acv", "resistant", 3.0)],
    }
    made = {n: df(rows, f"{'project_id' if n == 'setting' else 'run_id'} string, {store.LISTS[n]}") for n, rows in lists.items()}
    docs = store.run_documents(runs, *made.values())
    store.write_run_json(docs, str(tmp_path / "full"))
    tables, rejected = store.read_run_tables(spark, str(tmp_path / "full"))
    key = lambda x: sorted(map(str, map(tuple, x.collect())))
    assert rejected.count() == 0 and key(tables["run"]) == key(runs)
    for n, rows in lists.items():
        assert key(tables[n]) == sorted(str(("r1", *r[1:]) if n == "setting" else r) for r in rows)
    again = store.run_documents(runs, *[x.repartition(3) for x in made.values()])
    assert key(again) == key(docs)


def test_stored_runs_change_in_steps(spark, tmp_path):
    when = datetime.datetime(2026, 1, 2, 3, 4, 5)
    run = lambda *ids: spark.createDataFrame([(i, "p", "u", "s", "ref", when, status) for i, status in ids], store.RUN)
    variant = lambda *rows: spark.createDataFrame(rows, f"run_id string, {store.VARIANT}")
    key = lambda df: sorted(tuple(x) for x in df.collect())
    tables = versions.Tables(spark, str(tmp_path / "runs"), buckets=4)
    one = {"run": run(("r1", "done"), ("r2", "done"), ("r3", "done")), "variant_result": variant(*[(r, n, 5, "K", "E", "missense", 0.5) for r in ("r1", "r2") for n in range(3)])}
    assert store.save_runs(tables, "a", one) == 1 and store.save_runs(tables, "a", one) == 1
    assert tables.read("run").count() == 3 and tables.read("variant_result").count() == 6
    # A run that comes again takes the place of the old one in every table.
    assert store.save_runs(tables, "b", {"run": run(("r2", "again"))}) == 2
    before = tables.read("run")
    assert [x.status for x in before.filter("run_id = 'r2'").collect()] == ["again"] and {x.run_id for x in tables.read("variant_result").collect()} == {"r1"}
    assert store.delete_runs(tables, "c", spark.createDataFrame([("r1",), ("none",)], "run_id string")) == 3
    assert tables.read("variant_result").count() == 0 and [x.run_id for x in store.list_runs(tables.read("run")).collect()] == ["r2", "r3"]
    # Who opened a version reads it to the end.
    assert sorted(x.run_id for x in before.collect()) == ["r1", "r2", "r3"] and tables.read("run", 1).count() == 3
    # A new column is null where rows lack it; keys may be null.
    labels = spark.createDataFrame([("r3", "resistant"), (None, "x")], "run_id string, label string")
    store.put_rows(tables, "d", "sample_classification", labels, ["run_id"])
    store.put_rows(tables, "e", "sample_classification", spark.createDataFrame([(None, "y", 1)], "run_id string, label string, n int"), ["run_id"])
    assert sorted(str(tuple(x)) for x in tables.read("sample_classification").collect()) == ["('r3', 'resistant', None)", "(None, 'y', 1)"]
    assert tables.vacuum() > 0 and tables.read("run").count() == 2 and tables.version() == 5
    with pytest.raises(ValueError):
        store.save_runs(tables, "f", {"variant_result": one["variant_result"]})


def test_of_two_writers_one_wins(spark, tmp_path):
    tables = versions.Tables(spark, str(tmp_path / "t"), buckets=2)
    row = spark.createDataFrame([(1,)], "n int")
    tables.commit("a", {"t": (row, "n")})
    late = tables.manifest() | {"version": 1}
    with pytest.raises(versions.Conflict):
        tables._place(late)
    assert tables.version() == 1 and tables.read("t").count() == 1 and tables.read("t", 1).schema == row.schema


def test_numbers_over_ranges(spark):
    rows = [(i * 7919 % 1000, None if i % 50 == 0 else f"t{i % 9}") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    for n in (1, 4, 30):
        got = {(x.t, x.k): x.number for x in ranks.numbered(df, ["t", "k"], start=0, ranges=n).collect()}
        assert [got[t, k] for t, k in sorted(((t, k) for k, t in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1]))] == list(range(1000))
    assert ranks.numbered(df.limit(0), ["k"]).count() == 0


def test_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", "a.txt", "one\ntwo\n")
    run = lambda mark: ingest.start_ingest(spark, str(tmp_path / "in"), lambda df: df.select("value"), str(tmp_path / "store"), str(tmp_path / mark)).awaitTermination()
    run("mark")
    put(tmp_path / "in", "b.txt", "three\n")
    run("mark")
    assert sorted(x.value for x in spark.read.parquet(str(tmp_path / "store")).collect()) == ["one", "three", "two"]
    # Another checkpoint is another stream: it replaces nothing.
    run("other")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 6


@pytest.mark.parametrize(("text", "want"), [
    ("b AND a", "(a AND b)"), ("a and (c AND b)", "(a AND b AND c)"), ("A AND B OR C", "(C OR (A AND B))"), ("NOT A AND B", "(B AND (NOT A))"),
    ("NOT NOT a", "(NOT (NOT a))"), ("a XOR b XOR c", "(a XOR b XOR c)"), ("(a)", "a"), ("a OR b AND c XOR d", "(a OR (d XOR (b AND c)))"),
])
def test_canonical_formulas(text, want):
    assert formulas.compile_formula(text)[0] == want


@pytest.mark.parametrize("text", ["", None, "a b", "AND a", "a AND", "(a", "a)", "()", "a & b", "NOT", "a OR OR b"])
def test_formulas_that_do_not_parse(text):
    canonical, steps, names, problem = formulas.compile_formula(text)
    assert canonical is None and steps is None and names is None and problem


def test_three_true_parts_of_an_exclusive_or_must_meet(spark):
    f = formulas.compiled(spark.createDataFrame([(1, 1, "a XOR b XOR c"), (1, 2, "a XOR b"), (1, 3, "NOT a"), (1, 4, "a AND NOT d"), (1, 5, "a AND b")], "project_id int, formula_id int, expression string"))
    runs = spark.createDataFrame([("x", 1), ("y", 1)], "run_id string, project_id int")
    ev = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.9), ("x", "c", 0.9), ("y", "a", 0.4), ("y", "b", 0.4)], "run_id string, member string, lower double")
    got = {(r.run_id, r.formula_id): (list(r.members), round(r.lower, 6)) for r in formulas.evaluate_formulas(runs, ev, f).collect()}
    # Three parts of 0.9: 0.7 in common, 0.78 of the rarest. Two of 0.4 need not meet.
    assert got == {("x", 1): (["a", "b", "c"], 0.7), ("x", 4): (["a"], 0.9), ("x", 5): (["a", "b"], 0.8), ("y", 4): (["a"], 0.4)}


ANN = "run_id int, feature_id int, codon_pos int, codon_offset int, ref_codon string, alt_codon string, coding_alt string, ref_aa string, alt_aa string, consequence string, af double"


def test_codon_states(spark):
    two = spark.createDataFrame([(1, 1, 4, 0, "AAA", "TAA", "T", "K", "*", "stop_gained", 0.8), (1, 1, 4, 1, "AAA", "ATA", "T", "K", "I", "missense", 0.8)], ANN)
    got = {x.codon: x for x in codon.frechet_states(codon.codon_groups(two)).collect()}
    assert len(got) == 4 and [k for k, x in got.items() if x.accepted] == ["TTA"] and round(got["TTA"].lower, 9) == 0.6 and got["TTA"].upper == 0.8
    three = spark.createDataFrame([(1, 1, 4, i, "AAA", "", "T", "K", "", "missense", 0.9) for i in range(3)], ANN)
    got = {x.codon: x for x in codon.frechet_states(codon.codon_groups(three)).collect()}
    assert len(got) == 8 and round(got["TTT"].lower, 9) == 0.7
    many = spark.createDataFrame([(1, 1, 4, 0, "AAA", "", "T", "K", "", "missense", 0.5), (1, 1, 4, 0, "AAA", "", "G", "K", "", "missense", 0.3), (1, 1, 4, 1, "AAA", "", "T", "K", "", "missense", 0.8)], ANN)
    assert codon.frechet_states(codon.codon_groups(many)).count() == 6


def test_a_certain_state_takes_the_place_of_an_impossible_exchange(spark):
    rows = [(1, 1, 4, 0, "AAA", "TAA", "T", "K", "*", "stop_gained", 1.0), (1, 1, 4, 1, "AAA", "ATA", "T", "K", "I", "missense", 0.6)]
    got = {x.codon_offset: x for x in combined.combined_annotations(spark.createDataFrame(rows, ANN)).collect()}
    # The second never comes without the first: it shows TTA, and the first alone is what is left.
    assert (got[1].alt_codon, got[1].alt_aa, round(got[1].effect_freq, 9), got[1].consequence, list(got[1].states)) == ("TTA", "L", 0.6, "missense", [])
    assert (got[0].alt_codon, round(got[0].effect_freq, 9), [(s.aa, round(s.lower, 9)) for s in got[0].states]) == ("TAA", 0.4, [("L", 0.6), ("*", 0.4)])
    rules = spark.createDataFrame([(7, 1, 4, "K", "L", "d"), (8, 1, 4, "K", "I", "d")], "rule_id int, feature_id int, position int, reference string, mutation string, drug string")
    hit = [(x.rule_id, x.codon_offset, x.effect_aa, round(x.effect_freq, 9)) for x in combined.match_effects(combined.combined_annotations(spark.createDataFrame(rows, ANN)), rules).collect()]
    assert hit == [(7, 0, "L", 0.6)]


def test_strand_tokens(spark):
    x = spark.createDataFrame([("+",), ("minus",), ("-1",), ("Plus",)], "t string")
    assert [r[0] for r in x.select(knowledge.strand_sign(x.t)).collect()] == ["+", "-", "-", None]


def test_translation(spark):
    from clademark.functions import sequence as S

    want = {"ATG": "M", "taa": "*", "TAR": "*", "GCN": "A", "RAY": "B", "SAR": "Z", "MTT": "J", "TAN": "X", "NNN": "X", "---": "-", "A-G": "?", "AT": "?", "": "?", "ATY": "I"}
    x = spark.createDataFrame([(k,) for k in want], "c string")
    assert {r.c: r.a for r in x.select("c", S.translate_codon(x.c).alias("a")).collect()} == want
