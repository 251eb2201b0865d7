"""Numbers in a total order over all rows, without a task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of the sample that ranges are chosen from.
SAMPLE = 2_000


def _literal(field, value) -> Column:
    return F.lit(value).cast(field.dataType)


def numbered(rows: DataFrame, order: list[str], name: str = "number", start: int = 1, ranges: int | None = None) -> DataFrame:
    """Rows with their place in the ascending order of the columns ``order``, from ``start`` (O-1).

    Bounds from a sample cut the order into ranges; rows are counted in each, and a row's number is its place in its range after the rows of the ranges before. The
    bounds are part of the plan, so a repeated task cuts alike. The sample decides how even ranges are, never the numbers. Equal keys are numbered in any order.
    Nulls come first. ``rows`` is read three times: it should be a table or cheap.
    """
    spark = rows.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    sample = sorted_sample(rows, key) if ranges > 1 else []
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    kind = rows.select(key.alias("k")).schema["k"].dataType
    literal = lambda b: F.struct(*[_literal(f, v).alias(f.name) for f, v in zip(kind, b, strict=True)])
    cuts = list(dict.fromkeys(tuple(b) for b in bounds))
    at = F.lit(0)
    for b in cuts:
        at = at + F.when(key >= literal(b), 1).otherwise(0)
    placed = rows.withColumn("_range", at)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # One row for each range.
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.withColumn(name, own).join(F.broadcast(counts), "_range").withColumn(name, F.col(name) + F.col("_before") + F.lit(start - 1).cast("long")).drop("_range", "_before")


def sorted_sample(rows: DataFrame, key: Column, size: int = SAMPLE) -> list:
    """At most ``size`` keys, evenly by a hash of the rows."""
    drawn = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(size)
    return [x.k for x in drawn.orderBy("k").collect()]
