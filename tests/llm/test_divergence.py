import random
import re
from collections import Counter, defaultdict

import pytest

from clademark.llm import _store, divergence

SCHEMA = "text string, lang string, source string, doc_id long, n int, docs string, rows string, term string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    docs, groups, held, counts = [], defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for t, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = Counter(TERM.findall((t or "").translate(UPPER)))
        held[lang].update(own.keys())
        counts[lang, source].update(own)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        v = len(kept)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        q, by = p(total), {s: p(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(by[s][t], by[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(by[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and by[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -x, r) for r, (x, i) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, "d", "r", "t") for r in rows], SCHEMA)
    return sorted(map(tuple, divergence.audit(df.repartition(4), **more).select("lang", "source", "part", "item", "value", "rank").collect()))


def made():
    r = random.Random(3)
    vocab = ["Apple", "apple,", "(apple)", "Ünder", "ünder", "a1b2a", "x", "ÀB-cd", "don't", " wide　", "😀", "42", "--", "rare!"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(9)]
    say = lambda k: r.choice([" ", "\n", "\t ", "\x0b"]).join(r.choice(vocab[: 20 + 10 * k]) for _ in range(r.randrange(0, 40)))
    rows = [(say(i % 9), ["en", "de", None][i % 3], r.choice(["s0", "s0", "s1", "é", None, "S2"])) for i in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "only"), (None, None, None), ("solo words here", "it", "a"), ("1 2 3", "it", "b"), ("x", "it", None)]
    rows += [("once only-once, (once)", "pt", "a"), ("ONCE Twice twice.", "pt", "b"), ("Once; once/ twice", "pt", "b")] + [("same row", "pt", "c")] * 3
    return rows + [("long" * 100_000 + " " + "ab1" * 50_000, "en", "s0")] * 3


@pytest.mark.parametrize("few, cells", [(2000, 1 << 15), (5, 50)])
def test_equals_brute_force(spark, monkeypatch, few, cells):
    monkeypatch.setattr(_store, "FEW", few)
    monkeypatch.setattr(_store, "SENT", 4)
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = made()
    want = brute(rows)
    assert {x[2] for x in want} == {"pair", "term"} and ("it", "a", "pair", "b", 0, 2) in want
    assert got(spark, rows) == want


def test_thresholds_and_empty(spark):
    rows = made()[:60] + made()[-20:]
    for least in (1, 2):
        assert got(spark, rows, least=least, top=3) == brute(rows, least, 3)
    assert got(spark, []) == []
    with pytest.raises(ValueError):
        got(spark, [], least=4)


def test_counts_beyond_a_long_product(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 12_000_000_000_000, 5)], "c long, n long, v long")
    assert df.select(divergence._p(df.c, df.n, df.v)).first()[0] == 1 + 10**9 * (9_000_000_000_001) // (12_000_000_000_005)


def test_chunks_that_give_the_same_terms_are_one_row():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (["a"], ["s"], ["(Word, word. -- WORD-Über don't\n"], [7])], ["lang", "source", "text", "number"])
    got = [tuple(r.values()) for b in divergence._count_rows(iter([rows])) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted([("a", "s", None, 0, 0, None, None), ("a", "s", "word", 2, 1, 7, 7), ("a", "s", "word-Über", 1, 1, 7, 7), ("a", "s", "don't", 1, 1, 7, 7)], key=str)
