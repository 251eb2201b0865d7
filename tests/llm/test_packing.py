import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from clademark.llm.packing import Encoder, cuts, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = Encoder(PATH)
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
SCHEMA = "doc_id long, text string, ids string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\tab's'tre'll'vdmD19²é'’ß \u0085\x1c\x0b"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_ids_equal_the_tokenizer(texts):
    got = [x.tolist() for x in ENCODER.encode(texts)]
    assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts():
    for n in range(1, 5000):
        own = cuts(n, 1024)
        assert sum(own) == n and len(own) <= n // 1024 + 4 and max(own) <= 1024
        assert all(x >= 32 for x in own) or len(own) == n // 1024 + 1
        assert all(1024 // (1024 // x) - x <= 48 for x in own)


def test_pieces_put_documents_together(spark):
    texts = ["", None, "one", "two words 'll", "x y " * 3000, "é ñ 中文 <|endoftext|>", "one"] + [f"word{i} " * (i % 90) for i in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a", ""), (2, "one", "")]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for x in got:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4"))
        docs[x.doc_id].append(x)
        sequences[x.sequence_id].append(x)
    for i, t in enumerate(texts):
        own = sorted(docs[i], key=lambda x: x.start)
        want = PLAIN.encode(t or "", add_special_tokens=False).ids + [0]
        if i != 2:
            assert [k for x in own for k in x.ids] == want and all(x.doc_tokens == len(want) for x in own)
    assert len(docs[2]) == 2 * len(docs[6]) and docs[None]
    for own in sequences.values():
        own.sort(key=lambda x: x.offset)
        total = 0
        for x in own:
            assert x.offset == total
            total += x.length
        assert total <= 1024
    # Little padding but for what each of the three workers has open at its end.
    assert len(sequences) <= sum(x.length for x in got) / 1024 / 0.95 + 3
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
