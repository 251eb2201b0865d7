from collections import defaultdict

import pytest

from clademark.llm import _store, lines

SCHEMA = "doc_id long, text string, h1 string, kept int, lines string, n_lines string"
WHITE, UPPER = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    key = lambda x: x.strip(WHITE).translate(UPPER)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(i)
    low = lambda i: -(1 << 62) if i is None else i
    often = {k: max(ids, key=low) for k, ids in holders.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if often.get(key(x), i) == i]
        out.append((i, len(all_), len(all_) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "h", 1, "l", "n") for i, t in rows], SCHEMA)
    return sorted([(x.doc_id, x.n_lines, x.n_dropped, x.kept) for x in lines.drop_repeated_lines(df.repartition(3), **more).collect()], key=str)


@pytest.mark.parametrize("few", [2000, 3])
def test_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(_store, "FEW", few)
    monkeypatch.setattr(_store, "SENT", 4)
    long, other = "All rights reserved, see the licence FILE here", "Ünïcode LINE with ÀÉ that is long enough, à é"
    rows = [(i, f"own {i}\n  {long}\t\nend") for i in range(6)] + [(i, f"{long.lower()} \n{other}\n{long}\r\n") for i in range(10, 14)]
    rows += [(20, other), (21, f"\x0b{other}\x0c"), (22, other.lower()), (23, other), (24, other.replace("Ü", "ü"))]
    rows += [(i, "x" * 39 + "\n" + "é" * 40 + "\n\n") for i in range(30, 36)] + [(None, "é" * 40), (None, None), (None, None), (40, ""), (41, None), (42, "\n")]
    rows += [(50, f"{long}\n{other}")] * 3 + [(60, "\n".join([long, "filler", other] * 5000)), (61, "w" * 2_000_000), (62, "w" * 2_000_000 + "\na")]
    assert got(spark, rows) == brute(rows)


def test_rows_without_id_ties_and_thresholds(spark):
    line = "a line that is longer than forty code points, surely"
    rows = [(None, line + "\nx")] * 6
    assert got(spark, rows) == brute(rows) and all(x[2] == 0 for x in got(spark, rows))
    rows = [(i % 4, line) for i in range(8)]
    assert got(spark, rows) == brute(rows) and sum(x[2] for x in got(spark, rows)) == 6
    rows = [(i, "ab\ncd") for i in range(3)]
    assert got(spark, rows, least_chars=1, least_docs=3) == brute(rows, 1, 3) and got(spark, rows, least_chars=1, least_docs=3)[0][3] == ""
    assert got(spark, rows[:2], least_chars=1, least_docs=3) == brute(rows[:2], 1, 3)
    assert got(spark, []) == []


def test_no_python_in_the_plan(spark):
    plan = lines.drop_repeated_lines(spark.createDataFrame([(1, "a", "h", 1, "l", "n")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
