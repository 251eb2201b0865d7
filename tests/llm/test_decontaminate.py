import hashlib
import random
import re

from clademark.llm.decontaminate import contamination

DOCS, ITEMS = "doc_id long, text string, item_id string", "item_id long, text string, doc_id int"


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w = cut(t)
        hit, found = [False] * len(w), set()
        for k, s in items:
            v = cut(s)
            n = min(13, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit[j : j + n] = [True] * n
                    found.add(k)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), sum(hit), len(found), sha, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


def test_equals_brute_force_on_both_paths(spark):
    r = random.Random(5)
    vocab = [f"é{i}" if i % 3 else f"W{i}" for i in range(60)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(n, " ".join(say(r.choice([1, 3, 8, 12, 13, 14, 30])))) for n in range(7, 30)] + [(100, None), (101, "..")]
    docs = []
    for i in range(120):
        w = say(r.choice([0, 2, 10, 50, 200, 400]))
        for _ in range(r.randrange(3)):
            v = cut(r.choice(items)[1])
            a = r.randrange(len(v) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = v[a:] if r.random() < 0.5 else v
        docs.append((i, (", " if i % 2 else "\n").join(w)))
    docs += [(500, None), (501, ""), (501, ""), (502, "?!")]
    a = spark.createDataFrame([(i, t, "z") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    want = brute(docs, items)
    assert sum(x[5] for x in want) > 20
    for limit in (1_000_000, 0):
        assert sorted((tuple(x) for x in contamination(a, b, broadcast_words=limit).collect()), key=str) == want


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(a, b).count() == 0
    one = spark.createDataFrame([(1, "a b", None)], DOCS)
    assert contamination(one, b).first()[1:4] == (2, 0, 0)
    assert contamination(one, b, broadcast_words=-1).first()[1:4] == (2, 0, 0)


def test_null_ids_on_both_paths(spark):
    r = random.Random(6)
    say = lambda n: " ".join(f"w{r.randrange(1000)}" for _ in range(n))
    items = [(n if n % 3 else None, say(r.choice([5, 13, 40]))) for n in range(30)]
    items += [(77, items[1][1])]
    docs = [(None if i % 2 else i % 10, say(30) + " " + " ".join(t for _, t in r.sample(items, i % 7))) for i in range(60)]
    docs += [docs[3], docs[4], (None, None), (None, say(50) + " " + " ".join(t for _, t in items))]
    a = spark.createDataFrame([(i, t, "z") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    want = brute(docs, items)
    assert sum(x[0] is None and x[5] for x in want) > 20
    for options in ({}, {"broadcast_words": 0}, {"broadcast_words": 0, "part_words": 60}):
        assert sorted((tuple(x) for x in contamination(a, b, **options).collect()), key=str) == want
    carried = contamination(a, b, broadcast_words=0, carry=True).filter("contaminated").select("row.*").collect()
    assert sorted(((x.doc_id, x.text) for x in carried), key=str) == sorted(((i, t) for (i, t) in docs if brute([(i, t)], items)[0][5]), key=str)


def test_very_long_texts_and_repeated_items(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = "x y " * 300000 + item + " z" * 1000
    docs = [(1, long, ""), (1, long, ""), (2, item, ""), (3, "x " * 13, "")]
    items = [(7, item, 0), (8, item, 0), (7, item, 0), (9, "x y " * 2000, 0)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for words in (10**6, 1):
        got = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.contaminated) for x in contamination(d, b, broadcast_words=words).collect())
        assert got == [(1, 601020, 600020, 3, True), (1, 601020, 600020, 3, True), (2, 20, 20, 2, True), (3, 13, 0, 0, False)]
