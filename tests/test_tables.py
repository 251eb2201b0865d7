from clademark.operators import tables

RULES = "feature_id long, position int, mutation string, phenotype string"
FEATURES = "feature_id long, n_codons int"


def made(spark):
    rules = [(1, 3, "A", "resistant"), (1, 3, "A", "resistant"), (1, 4, "C", "susceptible"), (1, 4, "D", "susceptible"), (1, 451, "A", "resistant"), (1, 452, "A", "susceptible"), (2, 30, "A", "resistant"), (2, None, "A", "resistant")]
    return spark.createDataFrame(rules, RULES), spark.createDataFrame([(1, 455), (2, 21), (3, 10)], FEATURES)


def test_histogram_reaches_to_the_end_of_the_longest_feature(spark):
    got = {x.bin: x.n for x in tables.position_histogram(*made(spark)).collect()}
    assert sorted(got) == list(range(46))
    assert {b: n for b, n in got.items() if n} == {0: 3, 45: 2, 3: 1}


def test_histogram_by_feature_and_rank(spark):
    rows = tables.position_histogram_by_rank(*made(spark)).collect()
    assert sorted({x.bin for x in rows if x.feature_id == 1}) == list(range(46))
    assert sorted({x.bin for x in rows if x.feature_id == 2}) == [0, 1, 2, 3] and [x.bin for x in rows if x.feature_id == 3] == [0]
    some = {(x.feature_id, x.bin): [] for x in rows if x.n}
    for x in rows:
        if x.n:
            some[x.feature_id, x.bin].append((x.n, x.rank == x.dominant))
        else:
            assert x.rank is None and x.dominant is None
    assert {k: sorted(v) for k, v in some.items()} == {(1, 0): [(1, False), (2, True)], (1, 45): [(1, False), (1, True)], (2, 3): [(1, True)]}
    tie = {x.dominant for x in rows if (x.feature_id, x.bin) == (1, 45)}
    assert tie == {x.rank for x in rows if (x.feature_id, x.bin) == (2, 3)}
