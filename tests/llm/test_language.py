import numpy as np

from clademark.llm import language

SCHEMA = "doc_id long, text string, lang string, score int"
WORDS = {"aa": "der die und nicht ist ein", "bb": "the of and is not with", "cc": "le la et été pas une", "dd": "não é um do que à"}


def made(n=600, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(WORDS)[i % 4]
        rows.append((i, " ".join(r.choice(WORDS[lang].split(), r.integers(4, 150))), lang, 0))
    return rows


def test_held_out_accuracy_and_tables_equal_the_network(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    net = language.fit(df)
    got = language.predict(df, net).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [x for x in got if x.held_out]
    assert len(got) == 600 and len(out) > 100
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in out]) > 0.97
    cut = np.random.default_rng(1).integers(0, 256, (40, language.WINDOW)).astype(np.uint8)
    raw = net._forward(cut)[4]
    want = raw - raw.max(axis=1, keepdims=True)
    want -= np.log(np.exp(want).sum(axis=1, keepdims=True))
    assert np.allclose(language.log_probabilities(net.tables(), cut), want, atol=1e-3)


def test_windows_cover_every_byte_once_or_in_the_overlap():
    data = np.arange(1, 2000) % 255 + 1
    off = np.array([0, 0, 1, 256, 600, 1999])
    rows, doc, length = language.windows(data.astype(np.uint8), off)
    for i in range(5):
        own = rows[doc == i]
        size = off[i + 1] - off[i]
        step = language.WINDOW - max(language.WIDTHS) + 1
        seen = np.zeros(size, bool)
        for j, r in enumerate(own):
            n = length[doc == i][j]
            assert (r[:n] == data[off[i] + j * step : off[i] + j * step + n]).all() and not r[n:].any()
            seen[j * step : j * step + n] = True
        assert seen.all()


def test_odd_rows(spark):
    net = language.fit(spark.createDataFrame(made(200), SCHEMA))
    odd = [(1, None, "aa", 0), (2, "", None, 0), (3, "12 ..", "aa", 0), (None, "the of and", None, 0), (4, "der und " * 100000, "x", 0), (4, "der und " * 100000, "x", 0)]
    got = language.predict(spark.createDataFrame(odd, SCHEMA), net).collect()
    assert [x.lang_pred for x in got if x.doc_id in (1, 2, 3)] == ["und"] * 3 and len(got) == 6
    empty = spark.createDataFrame([], SCHEMA)
    none = language.fit(empty)
    assert language.predict(empty, none).count() == 0
    assert {x.lang_pred for x in language.predict(spark.createDataFrame(odd, SCHEMA), none).collect()} == {"und"}


def test_the_network_equals_filters_one_by_one():
    net = language.Network(["a", "b"], seed=5)
    row = np.random.default_rng(2).integers(0, 256, language.WINDOW)
    best = []
    for w in language.WIDTHS:
        for f in range(language.FILTERS):
            best.append(max(sum(float(net.p["e"][row[t + i]] @ net.p[f"w{w}"][i][:, f]) for i in range(w)) for t in range(language.WINDOW - w + 1)))
    hidden = np.maximum(np.array(best) + net.p["b"], 0)
    raw = hidden @ net.p["o"] + net.p["c"]
    want = raw - np.log(np.exp(raw).sum())
    assert np.allclose(language.log_probabilities(net.tables(), row[None].astype(np.uint8))[0], want, atol=1e-3)
