import random
import re

from clademark.llm import minhash
from clademark.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, n long, rep string"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    common = [r.choice(vocab) for _ in range(30)]
    out = []
    for g in range(40):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 12, 30, 60, 200]))]
        if g % 2:
            base = base[:15] + common + base[15:]
        for _ in range(r.choice([1, 2, 6, 20])):
            own = list(base)
            for _ in range(r.randrange(3)):
                own[r.randrange(len(own))] = r.choice(vocab)
            out.append(" ".join(own))
    out += ["", None, " \t\n", "A b C", "a B c", "É É É É É é", "one", "ONE"]
    return list(enumerate(out))


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    for k in (192, 48):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=k).collect()}
        assert got == brute(rows)


def test_empty_repeated_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "x y z " * 20000
    rows = [(1, "a b c d e f", 0, ""), (1, "a b c d e f", 0, ""), (None, "a b c d e f", 0, ""), (5, long, 0, ""), (4, long + "q", 0, "")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = brute([(1, rows[0][1]), (5, long), (4, long + "q")])
    assert got == [(1, 1, True), (1, 1, True), (4, *want[4][1:]), (5, *want[5][1:]), (None, None, True)]


def test_copies_of_one_text_meet_it_and_not_each_other(spark, monkeypatch):
    r = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):  # each is like the text that it was made from, two are not like each other
        own = list(base)
        for at in r.sample(range(10, 110, 10), 3):
            own[at + r.randrange(5)] = f"x{i}.{at}"
        rows.append((i, " ".join(own)))
    rows.append((999, " ".join(base)))
    made = {}

    def written(df, name):
        out = store(df, name)
        made[name] = out.count()
        return out

    store = minhash.written
    monkeypatch.setattr(minhash, "written", written)
    monkeypatch.setattr(minhash, "PAIRS", 0)
    got = near_duplicates(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA))
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got.collect()} == brute(rows)
    assert made["near"] + made["across"] <= 2 * len(rows), made
