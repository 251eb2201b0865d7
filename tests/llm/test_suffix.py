import hashlib
import random
from collections import Counter

import pytest

from clademark.llm.suffix import remove_repeats, repeats_and_passages

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (k, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    r = random.Random(seed)
    say = lambda n: "".join(r.choice("abcdeé ñ") for _ in range(n))
    shared = [say(r.choice([length // 2, length, length + 1, 2 * length, 5 * length])) for _ in range(12)]
    rows = []
    for i in range(150):
        t = say(r.randrange(3 * length))
        for _ in range(r.randrange(4)):
            s, at = r.choice(shared), r.randrange(len(t) + 1)
            a, b = sorted((r.randrange(len(s) + 1), r.randrange(len(s) + 1)))
            t = t[:at] + (s if r.random() < 0.4 else s[a:b]) + t[at:]
        rows.append((i, t))
    rows += [(900, "z" * (3 * length)), (901, "ab" * length), (902, None), (903, ""), (904, "x" * length), (905, "x" * length)]
    return rows + [rows[3], (None, rows[4][1]), (5, "other " + rows[6][1])]


@pytest.mark.parametrize(("seed", "length", "gram", "many"), [(1, 40, 8, 20_000), (2, 60, 16, 20_000), (3, 40, 8, 1)])
def test_equals_brute_force(spark, seed, length, gram, many):
    rows = corpus(seed, length)
    df = spark.createDataFrame([(i, t, "?") for i, t in rows], SCHEMA)
    got = sorted((tuple(x) for x in remove_repeats(df, length=length, gram=gram, many=many).collect()), key=str)
    assert got == brute(rows, length)


def test_texts_keep_whole_characters(spark):
    t = "é" * 30 + "x"
    rows = [(1, "a" + t), (2, "b" + t), (3, "")]
    got = {x.doc_id: x.kept for x in remove_repeats(spark.createDataFrame([(i, s, "") for i, s in rows], SCHEMA), length=41, gram=8, texts=True).collect()}
    assert got[3] == "" and got[1] == "a" and got[2] == "b"


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_beside_long_strings(spark):
    rows = corpus(4, 60)
    df = spark.createDataFrame([(i, t, "?") for i, t in rows], SCHEMA)
    got = repeats_and_passages(df, length=60, gram=16, passage=30, passage_gram=8, words=3).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got), key=str) == brute(rows, 60)
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 30] for b in bodies for i in range(len(b) - 29))
    want = []
    for (k, _), b in zip(rows, bodies, strict=True):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - 29):
            if seen[b[i : i + 30]] > 1:
                gone[i : i + 30] = b"\1" * 30
        edges = [i for i in range(len(gone)) if gone[i] != (gone[i - 1] if i else 0)]
        long = [b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True) if len(b[x:y].split()) >= 3]
        want.append((k, len(long), sum(map(len, long))))
    assert sorted(((x.doc_id, x.n_passages, x.passage_bytes) for x in got), key=str) == sorted(want, key=str)
    assert repeats_and_passages(spark.createDataFrame([], SCHEMA)).count() == 0
