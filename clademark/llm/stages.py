"""The operators as stages over ``documents``: each keeps the table's columns, but for the last.

Every stage gives an empty table for an empty one, decides each row by itself, with or without an id, and reads null texts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, minhash, packing, suffix, toxicity
from ._store import carried, dropped, scratch, written

#: Tells rows of a stage apart; ids may be null or repeated.
KEY = "_row"
#: Passages of over 50 words are cut; so many words take that many bytes at least in texts of words of 3.7 letters or more.
PASSAGE_WORDS, PASSAGE_BYTES, PASSAGE_GRAM = 51, 240, 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scores do not reject."""
    fm = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, fm, carry=True).filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, rows without id last."""
    # The row as one column, so that none of its columns can be taken for the number.
    keyed = written(docs.select(F.monotonically_increasing_id().alias(KEY), *carried(docs)), "keyed")
    with scratch(spark) as kept:
        groups = minhash.near_duplicates(keyed, id_col=KEY, text_col="row.text").select(F.col("doc_id").alias(KEY), "component_id")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)
        first = keyed.select("row.doc_id", KEY).join(groups, KEY).groupBy("component_id").agg(F.min(order).alias("first"))
        first = kept(first.select(f"first.{KEY}"), "first")
    return keyed.join(first, KEY, "left_semi").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur more than once; ``n_chars`` follows the text."""
    left = suffix.remove_repeats(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, least_words=PASSAGE_WORDS, texts=True, carry=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new else f"row.{c}" for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that test items do not contaminate."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.filter("not contaminated").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, with their ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def chain(spark: SparkSession, docs: DataFrame, sf_dir: str, stages: list) -> DataFrame:
    """Apply stages one after the other, each to what the one before has written; this is deleted when the next has written its own."""
    before = None
    for name, stage in stages:
        with scratch(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
