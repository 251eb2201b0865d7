import numpy as np

from clademark.llm.vectors import near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.93, kind=np.float32):
    good = {}
    for n, (i, v, y) in enumerate(rows):
        if i is not None and v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, kind).astype(float)
            good[n] = (i, x / np.sqrt(x @ x), y)
    root = {n: n for n in good}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    links = dict.fromkeys(range(len(rows)), 0)
    keys = sorted(good, key=lambda n: good[n][0])
    for x, a in enumerate(keys):
        for b in keys[:x]:
            if good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)), key=lambda n: good[n][0])
                root[q] = p
    out = []
    for n, (i, _, _) in enumerate(rows):
        c = good[find(n)][0] if n in good else i
        out.append((i, links[n], c, i is None or i == c))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = []
    for c in range(30):
        base = r.normal(size=6)
        for _ in range(int(r.integers(1, 25))):
            v = base + r.normal(size=6) * r.choice([0, 0.1, 0.3])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 6, 1), (1003, [float("nan")] * 6, 1), (1004, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1005, rows[0][1], None), (1006, rows[0][1], 0), (1007, rows[0][1][:5], 0), (None, rows[0][1], 0), (1008, [float("inf")] * 6, 0)]
    df = spark.createDataFrame([(*x, "") for x in rows], SCHEMA)
    want = brute(rows)
    for block, per in ((3000, 2000), (20, 10)):
        got = sorted((tuple(x) for x in near_duplicates(df, block=block, per_pivot=per).collect()), key=str)
        assert got == want


def test_repeated_ids_text_labels_and_doubles(spark):
    rows = [(1, [1.0, 0.0], "L1"), (1, [1.0, 0.01], "L1"), (2, [1.0, 0.02], "L1"), (3, [0.0, 1.0], "L2"), (1, [0.0, 1.0], "L2"), (1, [0.0, 1.0], "L2"), (4, [0.0, 1.0], "é"), (4, [0.5, 0.5], None)]
    # A cosine at the bound in double precision that single precision would lose.
    rows += [(10, [1.0, 0.0, 0.0], "x"), (11, [0.93, (1 - 0.93**2) ** 0.5 - 1e-9, 0.0], "x")]
    df = spark.createDataFrame([(*x, "") for x in rows], "vec_id long, embedding array<double>, label string, n_links string")
    got = sorted((tuple(x) for x in near_duplicates(df).collect()), key=str)
    assert got == brute(rows, kind=float)
    assert {x[0]: x[1] for x in got}[3] == 2 and {x[0]: x[1] for x in got}[11] == 1


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
