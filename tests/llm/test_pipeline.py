import random

import corpus_pipeline
from clademark.llm import stages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randrange(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, say(r.randrange(30, 150))) for i in range(300)]
    docs += [(300 + i, docs[i][1] + " tail") for i in range(20)]
    passage = say(120)
    docs += [(400 + i, say(200) + passage + say(200)) for i in range(5)]
    items = [(i, say(40)) for i in range(5)]
    docs += [(500 + i, say(50) + " " + t) for i, t in items]
    docs += [(600 + i, say(20) + " scum " + say(20) + " scum") for i in range(60)]
    labels = [(i, 0, 0) for i in range(300)] + [(600 + i, 0, 1) for i in range(60)]
    docs += [(700, None), (701, "")]
    return [(i, t, "en", "s", len(t or "")) for i, t in docs], items, labels, passage


def test_stages_take_out_what_they_should(spark, tmp_path):
    docs, items, labels, passage = made()
    at = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    seen = [{d[0]: d[1] for d in docs}]
    df = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stages.written(stage(spark, df, at), name)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append({x.doc_id: x.text for x in df.collect()})
    toxic = {i for i in seen[0] if 600 <= i < 660}
    assert set(seen[0]) - set(seen[1]) == toxic
    assert set(seen[1]) - set(seen[2]) == {300 + i for i in range(20)}
    assert set(seen[3]) == set(seen[2])
    for i, t in seen[3].items():
        if 400 <= i < 405:
            assert passage not in t and len(t) >= len(seen[2][i]) - len(passage) - 4
        else:
            assert t == seen[2][i]
    assert set(seen[3]) - set(seen[4]) == {500 + i for i in range(5)}
    packed = corpus_pipeline.run(spark, at).collect()
    assert {x.doc_id for x in packed} == set(seen[4])
    assert all(len(x.ids) == x.length for x in packed)


def test_rows_without_id_and_repeated_rows(spark, tmp_path):
    docs, items, labels, passage = made()
    r = random.Random(9)
    say = lambda n: " ".join("".join(r.choice("hijklmno") for _ in range(5)) for _ in range(n))
    insult = docs[-3][1]
    assert "scum" in insult
    other, near, copy = say(80), say(80), say(60)
    clean, bad = [say(90) for _ in range(4)], [say(50) + " " + items[0][1] for _ in range(2)]
    holds = [say(90) + passage + say(90) for _ in range(3)]
    odd = [
        (None, insult), (601, clean[0]),  # toxic without id; clean with the id of a toxic one
        (800, copy), (800, copy), (None, copy),  # equal rows
        (801, other), (801, near + " end"), (790, near),  # (801, other) stays, (801, near) is a copy of 790
        (None, holds[0]), (803, holds[1]), (803, clean[1]), (804, holds[2]), (804, holds[2] + say(90)),
        (None, bad[0]), (500, clean[2]), (None, clean[3]), (None, None), (None, None),
    ]
    at = str(tmp_path)
    spark.createDataFrame(docs + [(i, t, "en", "s", len(t or "")) for i, t in odd], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    df, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stages.written(stage(spark, df, at), name)
        seen.append([(x.doc_id, x.text, x.n_chars) for x in df.collect()])
    toxic, near_, cut, last = seen
    pairs = [[(i, t) for i, t, _ in rows] for rows in seen]
    assert not any(t and "scum" in t for _, t, _ in toxic) and (601, clean[0]) in pairs[0]
    assert len([1 for _, t in pairs[1] if t == copy]) == 1 and (800, copy) in pairs[1]
    assert (801, other) in pairs[1] and (790, near) in pairs[1] and (801, near + " end") not in pairs[1]
    assert len([1 for x in pairs[1] if x == (None, None)]) == 2
    assert len(near_) == len(cut) and not any(t and passage in t for _, t, _ in cut)
    assert all(n == len(t or "") for _, t, n in cut)
    assert sorted(i is None for i, t, _ in cut if t and t[:40] == holds[0][:40]) == [True]
    for i, t in ((803, clean[1]), (500, clean[2]), (None, clean[3]), (601, clean[0])):
        assert (i, t) in pairs[2] and (i, t) in pairs[3]
    assert (None, bad[0]) not in pairs[3] and len(last) == len(cut) - 6


def test_stages_on_an_empty_table(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    df = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, at)
        assert out.count() == 0 and (name == "packing" or out.columns == df.columns)


def test_columns_of_any_name_stay_with_their_rows(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    names = ["_row", "row", "kept", "component_id", "label", "n", "score", "first", "number", "docs"]
    r = random.Random(2)
    say = lambda: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(90))
    rows = [(i, say(), "en", "s", 0, *(f"{c} {i}" for c in names)) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stages.written(stage(spark, docs, at), name)
        assert sorted(map(tuple, docs.collect())) == rows
