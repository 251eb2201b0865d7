from collections import Counter, defaultdict

import xxhash

from clademark.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard int"


def test_shards_are_a_repeatable_shuffle(spark):
    rows = [(i, "t" * (i % 70), "", 0) for i in range(4000)] + [(None, "a", "", 0), (7, None, "", 0), (7, None, "", 0), (9, "é" * 50000, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.documents(df.repartition(5), bucket_bytes=1000).collect()
    again = sharding.documents(df.repartition(3), bucket_bytes=1000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert Counter((x.doc_id, x.text) for x in got) == Counter((r[0], r[1]) for r in rows)
    by = defaultdict(list)
    for x in got:
        assert x.size == len((x.text or "").encode()) + 8 and x.grown_shard in (x.shard, 24)
        by[x.shard].append(x)
    assert set(by) == set(range(24))
    for own in by.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
        ids = [x.doc_id or 0 for x in sorted(own, key=lambda x: x.slot)]
        rising = sum(a < b for a, b in zip(ids, ids[1:]))
        assert 0.3 < rising / len(ids) < 0.7
    moved = sum(x.grown_shard == 24 for x in got) / len(got)
    assert 0.02 < moved < 0.07
    assert sharding.documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "", 0) for i in range(200)], SCHEMA)
    sharding.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


def test_no_python_in_the_plan(spark):
    plan = sharding.documents(spark.createDataFrame([(1, "a", "", 0)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def hash64(*values):
    """The engine's chained 64-bit hash of longs, ints (given as ``[n]``) and strings; nulls are passed over."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, list) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute(rows, shards, bucket_bytes, bucket_rows):
    """Shard and slot of every row, one by one."""
    place = lambda k, n: max(range(n), key=lambda s: (hash64(k, [20], [s]), -s))
    by, out = defaultdict(list), []
    for k, t in rows:
        size = len((t or "").encode()) + 8
        by[place(k, shards)].append((hash64(k, t, size, [21]), k, t, size))
    for shard, own in by.items():
        n = max(len(own) // bucket_rows, sum(x[3] for x in own) // bucket_bytes) + 1
        seen, buckets = Counter(x[0] for x in own), defaultdict(list)
        copy = Counter()
        for w, k, t, _ in own:
            if seen[w] > bucket_rows:
                copy[w] += 1
                w = hash64(w, copy[w] - 1)
            buckets[w % n].append((k is not None, k or 0, w, t))
        slot = 0
        for b in sorted(buckets):
            rows_, order = sorted(buckets[b]), [0]
            for i in range(1, len(rows_)):
                j = hash64([20], [shard], [b], [i]) % (i + 1)
                order.append(i if j == i else order[j])
                order[j] = i
            for i in order:
                has, k, _, t = rows_[i]
                out.append((k if has else None, t, shard, slot, place(k if has else None, shards + 1)))
                slot += 1
    return sorted(out, key=str)


def test_equals_brute_force_with_any_partitioning(spark):
    rows = [(i, "t" * (i % 70)) for i in range(1500)] + [(None, "a"), (7, None), (7, None), (9, "é" * 5000)] + [(11, "same")] * 300
    df = spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)
    want = brute(rows, 5, 4000, 40)
    adaptive, parts = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sharding.documents(df.repartition(n), shards=5, bucket_bytes=4000, bucket_rows=40)
            assert sorted([(x.doc_id, x.text, x.shard, x.slot, x.grown_shard) for x in got.collect()], key=str) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
