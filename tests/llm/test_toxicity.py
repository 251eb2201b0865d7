import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from clademark.llm import toxicity

DOCS, LABELS = "doc_id long, text string, toxic string", "doc_id long, toxic int, text string"


def made(n=3000, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(400)}" for _ in range(r.randrange(5, 60))]
        a, b = r.random() < 0.4, r.random() < 0.4
        w += ["fool"] * a + ["group"] * b
        r.shuffle(w)
        docs.append((i, " ".join(w), "0"))
        labels.append((i, int(a and b), "x"))
    return docs, labels


def test_pairs_are_learned_and_held_out_rows_hold(spark):
    docs, labels = made()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    fm = toxicity.fit(d, y)
    got = toxicity.score(d, fm).collect()
    truth = {i: t for i, t, _ in labels}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    out = [x for x in got if x.held_out]
    right = np.mean([(x.score >= 0.5) == (truth[x.doc_id] == 1) for x in out])
    assert right > 0.97
    assert all(x.predicted == int(x.score >= 0.7) and 0 <= x.score <= 1 for x in got)
    # Labels of held-out rows change nothing.
    other = y.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(d, other).weight, fm.weight)


def test_odd_rows(spark):
    docs, labels = made(300)
    labels += [(0, 1 - labels[0][1], ""), (None, 1, ""), (5, None, ""), (10**6, 1, "")]
    fm = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    odd = [(1, None, ""), (2, "", ""), (3, "..", ""), (None, "fool group", ""), (4, "a " * 200000, ""), (4, "a " * 200000, "")]
    got = toxicity.score(spark.createDataFrame(odd, DOCS), fm).collect()
    assert len(got) == 6 and len({x.score for x in got if x.doc_id in (1, 2, 3)}) == 1
    empty = spark.createDataFrame([], DOCS)
    none = toxicity.fit(empty, spark.createDataFrame([], LABELS))
    assert toxicity.score(empty, none).count() == 0
    assert toxicity.score(spark.createDataFrame(odd, DOCS), none).count() == 6


def test_scores_equal_every_pair_one_by_one():
    r = np.random.default_rng(3)
    fm = toxicity.Machine(np.where(np.arange(50) % 3 == 0, -1, np.cumsum(np.arange(50) % 3 != 0) - 1), 4)
    fm.bias, fm.weight, fm.factor = 0.3, r.normal(size=len(fm.weight)), r.normal(size=fm.factor.shape)
    docs = [sorted(r.choice(50, n, replace=False)) for n in (0, 1, 2, 7, 20)]
    want = []
    for d in docs:
        at = [int(fm.place[b]) for b in d if fm.place[b] >= 0]
        raw = fm.bias + sum(fm.weight[i] for i in at)
        raw += sum(float(fm.factor[i] @ fm.factor[j]) for n, i in enumerate(at) for j in at[:n])
        want.append(1 / (1 + np.exp(-raw)))
    got = fm.scores(np.array([b for d in docs for b in d], np.int64), np.array([len(d) for d in docs]))
    assert np.allclose(got, want)


def test_a_term_that_says_nothing_alone_counts_beside_another(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(4000):
        # "friend" is as frequent in documents of either label, but turns "fool".
        a, b = r.random() < 0.3, r.random() < 0.5
        y = (a and not b) or (not a and r.random() < 0.15 and b)
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 40))] + ["fool"] * a + ["friend"] * b
        r.shuffle(w)
        docs.append((i, " ".join(w), "0"))
        labels.append((i, int(y), "x"))
    fm = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    odd = spark.createDataFrame([(1, "fool w1 w2", ""), (2, "fool friend w1 w2", ""), (3, "friend w1 w2", "")], DOCS)
    score = {x.doc_id: x.score for x in toxicity.score(odd, fm).collect()}
    assert score[1] > 0.7 and score[2] < 0.4 and score[3] < 0.4
