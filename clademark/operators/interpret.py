"""From hits to one assessment per run and drug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequence import label_to_rank, strength


def drug_table(hits: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Hits of each run and drug put together (A-9): number, sum of scores, largest ic50, counts by rank.

    ``scope`` (``run_id, drug``) keeps drugs without hit.
    """
    rank = label_to_rank(F.col("phenotype"))
    out = hits.groupBy("run_id", "drug").agg(
        F.count("*").alias("hit_count"), F.sum("score").alias("score"), F.max("ic50").alias("max_ic50"),
        *(F.count_if(rank == r).alias(f"rank_{r}" if r >= 0 else "rank_contradictory") for r in (5, 4, 3, 2, 1, 0, -1)),
    )
    if scope is None:
        return out
    counts = {c: 0 for c in out.columns if c.startswith("rank_") or c == "hit_count"}
    return scope.join(out, ["run_id", "drug"], "left").na.fill(counts)


def assess_by_phenotype(hits: DataFrame) -> DataFrame:
    """Highest rank of 2 or more, else contradictory, else 1; its most frequent label, alphabetical on ties (K-3)."""
    by = hits.withColumn("rank", label_to_rank(F.col("phenotype"))).groupBy("run_id", "drug", "rank", F.col("phenotype").alias("label")).agg(F.count("*").alias("n"))
    w = W.partitionBy("run_id", "drug").orderBy(strength(F.col("rank")).desc(), F.desc("n"), "label")
    return by.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("run_id", "drug", "rank", "label")


def _reached(thresholds: DataFrame, value, rows: int = 1_000):
    """The strongest (rank, threshold, label) that a value reaches, as one expression. Thresholds are settings: more than ``rows`` of them are an error."""
    t = thresholds.select(label_to_rank(F.col("label")).alias("rank"), F.col("value").cast("double").alias("threshold"), "label").limit(rows + 1).collect()
    if len(t) > rows:
        raise ValueError(f"more than {rows} thresholds")
    best = F.lit(None).cast("struct<rank:int,threshold:double,label:string>")
    for x in sorted(t, key=lambda x: (x.rank, x.threshold, x.label)):
        own = F.struct(F.lit(x.rank).alias("rank"), F.lit(x.threshold).alias("threshold"), F.lit(x.label).alias("label"))
        best = F.when(F.lit(True) if x.rank == 1 else value >= x.threshold, own).otherwise(best)
    return best


def assess_by_value(drugs: DataFrame, thresholds: DataFrame, field: str = "score") -> DataFrame:
    """The strongest label whose threshold the drug's value reaches; rank 1 is the floor (K-4, K-5).

    ``thresholds``: ``label, value``, a handful of settings (at most 1,000), which become one expression. A drug that reaches none is left out.
    """
    x = drugs.withColumn("b", _reached(thresholds, F.col(field))).filter("b is not null")
    return x.select("run_id", "drug", F.col("b.rank").alias("rank"), F.col("b.label").alias("label"))


def assess_drugs(hits: DataFrame, thresholds: dict[str, DataFrame]) -> DataFrame:
    """All methods and the final call in one pass over the hits (K-3 to K-6): ``run_id, drug, rank, label, method_no``.

    Method 1 is the phenotype; the others are the ``thresholds`` in their order, by field: ``score`` counts by its sum, other fields by the largest
    value. The strongest assessment stays, the earlier method on ties. Hits are counted by label first, so what is put together is small.
    """
    rank = label_to_rank(F.col("phenotype"))
    pick = {f: F.sum if f == "score" else F.max for f in thresholds}
    by = hits.groupBy("run_id", "drug", rank.alias("rank"), F.col("phenotype").alias("label")).agg(F.count("*").alias("n"), *(g(f).alias(f) for f, g in pick.items()))
    first = F.struct((-strength(F.col("rank"))).alias("s"), (-F.col("n")).alias("n"), "label", "rank")
    drug = by.groupBy("run_id", "drug").agg(F.min(first).alias("top"), *(g(f).alias(f) for f, g in pick.items()))
    methods = [F.struct(F.lit(1).alias("method_no"), F.col("top.rank").alias("rank"), F.col("top.label").alias("label"))]
    for i, (field, t) in enumerate(thresholds.items()):
        b = _reached(t, F.col(field))
        methods.append(F.when(b.isNotNull(), F.struct(F.lit(i + 2).alias("method_no"), b["rank"].alias("rank"), b["label"].alias("label"))))
    order = F.transform(F.array_compact(F.array(*methods)), lambda m: F.struct((-strength(m["rank"])).alias("s"), m["method_no"].alias("method_no"), m["rank"].alias("rank"), m["label"].alias("label")))
    return drug.withColumn("m", F.array_min(order)).select("run_id", "drug", "m.rank", "m.label", "m.method_no")


def metric_stats(values: DataFrame, value: str) -> DataFrame:
    """Mean and sample deviation; null for fewer than two values or no spread (A-12)."""
    x = values.filter(F.col(value).isNotNull()).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    fine = (F.col("n") >= 2) & (F.col("std") > 0)
    return x.select(F.when(fine, F.col("mean")).alias("mean"), F.when(fine, F.col("std")).alias("std"), "n")


def metric_tier(value, mean, std):
    """1 to 4: up to the mean, one deviation, two deviations, above (A-12b)."""
    return F.when(value <= mean, 1).when(value <= mean + std, 2).when(value <= mean + 2 * std, 3).otherwise(4)
