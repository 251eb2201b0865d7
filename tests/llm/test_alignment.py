import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from clademark.llm import _store, alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, groups string, pair long, docs int, row string, n_best string"


def brute(rows):
    """Whole texts by the libraries themselves, links by comparing every token with every other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    made, counts = [], Counter()
    for key, text in rows:
        full, ids_a, ids_b = (" " + (text or "")).encode(), [], []
        if text:
            got = a.encode(" " + text, add_special_tokens=False)
            ids_a, ids_b = [(i, bytes(letter[c] for c in t)) for i, t in zip(got.ids, got.tokens)], [(i, piece(i)) for i in b.encode(text)]
            if b"".join(x for _, x in ids_a) != full or b"".join(x for _, x in ids_b) != full:
                ids_a, ids_b = [], []
        spans = []
        for ids in (ids_a, ids_b):
            at = 0
            spans.append([])
            for i, x in ids:
                spans[-1].append((i, at, at + len(x)))
                at += len(x)
        links, j0 = [], 0
        for i, lo, hi in spans[0]:
            while spans[1][j0][2] <= lo:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][1] < hi:
                links.append((i, spans[1][j][0]))
                j += 1
        counts.update(set(links))
        common = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        place, cut = {x: k for k, x in enumerate(common)}, [[[] for _ in common] for _ in spans]
        for side, s in zip(cut, spans):
            k = 0
            for i, _, hi in s:
                side[k].append(str(i))
                k = place.get(hi, k - 1) + 1
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in zip(*cut)]
        made.append((key, len(spans[0]), len(spans[1]), len(common), len(links), ";".join(groups), links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(*x[:6], sum(counts[p] == best[p[0]] for p in x[6]), sum(counts[p] for p in x[6])) for x in made]


def rows():
    r = random.Random(5)
    parts = ["the", "Straße", "été ", "don't", "I'll", "  ", " ", "\n", "\n  ", "\t", "x", "été", "，", "漢字", "😀🚀", "<s>", "<|endoftext|>", "<0x41>", "1234", "…", " ", "　", " ", "á", "\x00", "\x7f", "'", "foo_bar", "!!", " ", "\x85", "À", "\x1c"]
    out = [(i, "".join(r.choice(parts) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(1, 40)))) for i in range(250)]
    out += [(300, None), (301, ""), (302, " "), (303, "   "), (304, "a ▁ b"), (305, "▁"), (None, "the cat"), (None, "the cat"), (306, "the cat"), (306, None)]
    return out + [(400, "word " * 30_000), (401, "ab7-" * 20_000), (402, "\n".join(["line of text"] * 3000))]


def got(spark, made, **more):
    df = spark.createDataFrame([(i, t, "g", 1, 1, "r", "b") for i, t in made], SCHEMA)
    out = alignment.align(df.repartition(3), A, B, **more)
    return sorted([(x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.groups, x.n_best, x.count_sum) for x in out.collect()], key=str)


@pytest.mark.parametrize("sent", [None, 10])
def test_equals_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(_store, "FEW", 20)
    monkeypatch.setattr(_store, "SENT", 50)
    monkeypatch.setattr(alignment, "SHARD", 64)
    made = rows()
    want = brute(made)
    assert sum(x[1] > 0 for x in want) > 240 and not any(x[4] > 0 for x in want if x[0] in (300, 301, 304, 305))
    for x, y in zip(got(spark, made, sent_pairs=sent), sorted(want, key=str), strict=True):
        assert x == y


def test_empty(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_hash_is_minimal_and_perfect():
    import pyarrow as pa

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 47, 20_000))
    plan = alignment.PerfectHash([], 5)
    shard = plan.shard(keys)
    built = [alignment._build((pa.scalar(s),), pa.table({"pair": keys[shard == s]})).to_pylist()[0] for s in range(5)]
    perfect = alignment.PerfectHash([(x["shard"], x["sizes"], x["bits"]) for x in built], 5)
    at = perfect(keys)
    assert sorted(at.tolist()) == list(range(len(keys)))
    order = np.concatenate([np.frombuffer(x["keys"], np.int64) for x in built])
    assert (order[at] == keys).all()
    counts = alignment.Counts(perfect, order, np.ones(len(order), np.int64))
    with pytest.raises(ValueError):
        counts(np.setdiff1d(np.arange(1000), keys))
