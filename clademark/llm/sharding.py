r"""Seeded two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters records uniformly by seeded hashes: the shard by the largest of one hash for each
shard (so that one more shard takes records only into itself), and inside a shard a bucket, of which there are
as many as keep a bucket near ``bucket_bytes`` and ``bucket_rows``. Pass two puts the records of a bucket in a fixed order,
gives them a Fisher-Yates shuffle whose draws are hashes of seed, shard, bucket and step, and numbers them; buckets
follow one another in a shard. Shards and slots depend on the records, the seed and the sizes
alone, so both passes repeat exactly, after a lost executor and with any partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import SENT, dropped, written

SHARDS = 24
BUCKET_BYTES = 8 << 20
#: A bucket's shuffle builds its order step by step, at a cost of the square of its rows.
BUCKET_ROWS = 512
#: Copies of a repeated record that are made from one row.
COPIES = 10_000
SEED = 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash with the key is the largest; ties go to the smaller shard."""
    each = [F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return (-reduce(F.greatest, [F.greatest(*each)] if shards > 1 else each)["s"]).cast("int")


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 to n - 1: element i is put at a place drawn from 0 to i, and what was there moves to the end."""
    draw = lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int").alias("j"))
    moved = lambda own, x: F.concat(F.slice(own, F.lit(1), x["j"]), F.array(x["i"]), F.slice(own, x["j"] + 2, x["i"] - x["j"] - 1), F.array(F.get(own, x["j"])))
    step = lambda own, x: F.when(x["j"] == x["i"], F.concat(own, F.array(x["i"]))).otherwise(moved(own, x))
    one = F.array(F.lit(0))
    return F.when(n < 2, one).otherwise(F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), draw), one, step))


def _copies(records: DataFrame) -> DataFrame:
    """Each record ``c`` times, with a ``w`` of its own each time; many copies are made in many tasks."""
    last = F.floor((F.col("c") - 1) / COPIES)
    block = records.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("w", "block")
    own = F.sequence(F.col("block") * COPIES, F.least(F.col("c"), (F.col("block") + 1) * COPIES) - 1)
    return block.withColumn("copy", F.explode(own)).withColumn("w", F.xxhash64("w", "copy")).drop("block", "copy", "c")


def shuffled(records: DataFrame, key: str = "doc_id", size: str = "size", shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All columns of ``records`` with ``shard``, ``slot`` (gapless from 0 in its shard) and ``grown_shard`` (with one more shard).

    ``key`` decides the shard, so records with one key share it; their buckets differ, as
    those depend on the whole record. Exactly equal records are dealt to buckets copy by copy where
    they are more than a bucket holds. A null key is a key of its own.
    """
    names = records.columns
    # Placed by the key and a hash of the record.
    whole = F.xxhash64(*[F.col(c) for c in names], F.lit(seed + 1))
    placed = records.select(F.struct(*names).alias("r"), F.col(key).alias("k"), shard_of(F.col(key), shards, seed).alias("shard"), whole.alias("w"), shard_of(F.col(key), shards + 1, seed).alias("grown"))
    seen = written(placed.groupBy("shard", "w").agg(F.count("*").alias("c"), F.sum(f"r.{size}").alias("bytes")), "seen")
    # A row for each shard.
    sizes = {x.shard: max(x.n // bucket_rows, x.bytes // bucket_bytes) + 1 for x in seen.groupBy("shard").agg(F.sum("c").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    buckets = F.get(F.array(*[F.lit(sizes.get(i, 1)) for i in range(shards)]), F.col("shard"))
    # Records of more copies than this are fewer than SENT.
    often = F.col("c") > max(bucket_rows, (seen.agg(F.sum("c")).first()[0] or 0) // SENT)
    counts = seen.select("shard", "w", "c")
    many = written(counts.filter(often), "many")
    if not many.isEmpty():
        keys = F.broadcast(many.select("shard", "w"))
        copies = placed.join(keys, ["shard", "w"], "left_semi").groupBy(placed.columns).agg(F.count("*").alias("c"))
        placed = placed.join(keys, ["shard", "w"], "left_anti").unionByName(_copies(copies))
        counts = counts.filter(~often).unionByName(_copies(many).withColumn("c", F.lit(1).cast("long")))
    bucket = F.pmod("w", buckets).cast("int").alias("bucket")
    # As many rows as shards and buckets: offsets of the buckets.
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.groupBy("shard", bucket).agg(F.sum("c").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = written(offsets, "offsets")
    dropped(seen)
    # The texts are shuffled once: the offsets come to where the buckets are gathered.
    grouped = placed.groupBy("shard", bucket).agg(F.sort_array(F.collect_list(F.struct("k", "w", "grown", "r"))).alias("rows"))
    mixed = grouped.join(offsets, ["shard", "bucket"])
    order = fisher_yates(F.size("rows"), F.lit(seed), F.col("shard"), F.col("bucket"))
    out = mixed.select("shard", "offset", F.posexplode(F.transform(order, lambda i: F.get(F.col("rows"), i))).alias("i", "x"))
    return out.select("x.r.*", "shard", (F.col("offset") + F.col("i")).alias("slot"), F.col("x.grown").alias("grown_shard"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Shuffle documents: ``doc_id, text, size, shard, slot, grown_shard``, one row per input row.

    ``size`` is the UTF-8 bytes of the text (null has none) plus 8 for the id. Empty tables give an empty result; other columns are dropped.
    """
    text = F.col(text_col)
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
    return shuffled(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), size.alias("size")), **more)


def write_shards(docs: DataFrame, path: str, **more) -> None:
    """Write shuffled documents as Parquet, a folder for each shard, rows in the order of their slots."""
    out = documents(docs, **more)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
