"""Gaps as ranges and the matrix of samples against counting one by one."""

import random

from clademark.operators import compare, coverage


def test_gaps_equal_codon_by_codon(spark):
    r = random.Random(1)
    features = [(1, 12), (2, 7), (3, 1)]
    rows, want = [], set()
    for run in ("a", "b", "c"):
        for f, n in features:
            if (run, f) == ("c", 2):
                continue
            depth, at = [0] * (3 * n + 6), 0
            while at < 3 * n + 6:
                size, d = r.randrange(1, 8), r.choice([0, 5, 10, 30])
                if d:
                    rows.append((run, f, at, min(at + size, 3 * n + 6), d))
                    depth[at : at + size] = [d] * len(depth[at : at + size])
                at += size
            if any(depth):
                want |= {(run, f, c) for c in range(n) if min(depth[3 * c : 3 * c + 3]) < 10}
    rows.append(("d", 2, 0, 2, 50))
    want |= {("d", 2, c) for c in range(7)}
    args = spark.createDataFrame(features, "feature_id long, n_codons int"), spark.createDataFrame(rows, "run_id string, feature_id long, start int, end int, depth int")
    got = coverage.uncovered_codons(*args)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    merged = {tuple(x) for x in coverage.merge_codon_gaps(got).select("run_id", "feature_id", "codon_start", "codon_end").collect()}
    assert {tuple(x) for x in coverage.uncovered_ranges(*args).collect()} == merged


def test_matrix_equals_cell_by_cell(spark, monkeypatch):
    monkeypatch.setattr(compare, "TOGETHER", 3)
    r = random.Random(2)
    ann = [(f"r{r.randrange(20)}", r.randrange(3), r.randrange(9), "K", r.choice("AC"), r.choice([0.25, 0.5, 1.0]), r.choice(["missense", "synonymous"])) for _ in range(120)]
    runs = [f"r{i}" for i in range(25)]
    gaps = [(f"r{r.randrange(25)}", r.randrange(3), a, a + r.randrange(3)) for a in range(9) for _ in range(4)]
    hits = [x[:5] for x in ann[::7]]
    cells, marked = {}, set(hits)
    for *key, af, kind in ann:
        if kind != "synonymous":
            cells[tuple(key)] = max(af, cells.get(tuple(key), 0))
    keys = {k[1:] for k in cells}
    df = lambda rows, s: spark.createDataFrame(rows, s)
    place = "run_id string, feature_id int, codon_pos int, ref_aa string, alt_aa string"
    args = df(ann, f"{place}, af double, consequence string"), df([(x,) for x in runs], "run_id string"), df(gaps, "run_id string, feature_id int, codon_start int, codon_end int"), df(hits, place)
    for only in (False, True):
        live = {k for k in keys if any(c in marked and c[1:] == k for c in cells)} if only else keys
        lost = lambda x, k: any(g[0] == x and g[1] == k[0] and g[2] <= k[1] <= g[3] for g in gaps)
        want = {(x, *k): (cells.get((x, *k), None if lost(x, k) else 0.0), (x, *k) in cells and (x, *k) in marked) for x in runs for k in live}
        got = compare.mutation_matrix(*args, non_synonymous_only=True, db_hits_only=only).collect()
        assert {tuple(x)[:5]: tuple(x)[5:] for x in got} == want and len(got) == len(want)


def test_gaps_end_with_the_feature_and_join_ranges(spark):
    features = spark.createDataFrame([(1, 4), (2, 3)], "feature_id long, n_codons int")
    rows = [("a", 1, 0, 2, 20), ("a", 1, 2, 7, 20), ("a", 1, 18, 21, 20), ("a", 2, 0, 30, 9), ("b", 2, 0, 30, 10), ("b", 1, 4, 11, 10), ("b", 1, 11, 12, 3)]
    got = coverage.uncovered_ranges(features, spark.createDataFrame(rows, "run_id string, feature_id long, start int, end int, depth int"))
    assert {tuple(x) for x in got.select("run_id", "feature_id", "codon_start", "codon_end").collect()} == {("a", 1, 2, 3), ("a", 2, 0, 2), ("b", 1, 0, 1), ("b", 1, 3, 3)}
    ranges = spark.createDataFrame([("a", 1, 0, 2), ("a", 1, 3, 3), ("a", 1, 5, 9), ("a", 1, 6, 7), ("b", 1, 4, 4)], "run_id string, feature_id long, codon_start int, codon_end int")
    assert {tuple(x)[:4] for x in coverage.merge_codon_gaps(ranges).collect()} == {("a", 1, 0, 3), ("a", 1, 5, 9), ("b", 1, 4, 4)}


def test_lost_codons_are_counted_without_listing_them(spark):
    from pyspark.sql import functions as F

    rows = [("a", 1, 4, p, 6, 1) for p in range(6) for _ in range(2)] + [("a", 1, 4, 9, 50, 0), ("a", 1, 4, 12, 50, 0), ("b", 2, 1, 0, 9, 0), ("b", 2, 1, 1, 30, 0), ("b", 2, 1, 2, 30, 5), ("c", 2, 1, 0, 10, 0), ("c", 2, 1, 1, 10, 0), ("c", 2, 1, 2, 10, 0)]
    calls = spark.createDataFrame(rows, "run_id string, feature_id long, n_codons int, cds_pos int, depth int, x int")
    got = coverage.lost_codons(calls, {"x": F.sum("x")})
    assert {tuple(r) for r in got.collect()} == {("a", 1, 2, 12), ("b", 2, 1, 5), ("c", 2, 0, 0)}
