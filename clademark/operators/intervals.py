"""Points in intervals as an equi-join over bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str = "pos", start: str = "start", end: str = "end", bin: int = 256, how: str = "inner") -> DataFrame:
    """Join points with the half-open intervals that hold them, by equal ``keys``.

    Each interval is listed in the bins that it touches, each point is in one, so the join is an
    equi-join on the bin with the range as a rest. A range predicate alone would be planned as a nested loop.
    ``bin`` should be near the usual length of the intervals.
    """
    by = lambda c: F.floor(F.col(c) / bin)
    listed = intervals.withColumn("_bin", F.explode(F.sequence(by(start), F.floor((F.col(end) - 1) / bin))))
    p, q = points.withColumn("_bin", by(point)).alias("p"), listed.alias("q")
    on = F.expr(" AND ".join(f"p.`{k}` = q.`{k}`" for k in [*keys, "_bin"]) + f" AND p.`{point}` >= q.`{start}` AND p.`{point}` < q.`{end}`")
    kept = [F.col(f"q.`{c}`") for c in intervals.columns if c not in keys]
    return p.join(q, on, how).select("p.*", *kept).drop("_bin")
