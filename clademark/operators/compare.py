"""Comparison of samples and of knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import COMPONENT_DRUG

#: Samples whose cells of a mutation are held in one row, and samples that go to every task at most.
TOGETHER, SENT = 64, 100_000
#: Codons of a feature that look at the same gaps.
PLACES = 64
KEY = ["feature_id", "codon_pos", "ref_aa", "alt_aa"]


def mutation_matrix(ann: DataFrame, runs: DataFrame, gaps: DataFrame, hits: DataFrame | None = None, non_synonymous_only: bool = False, db_hits_only: bool = False) -> DataFrame:
    """Long form of samples by mutations (M-1): the frequency where found, null in a gap of the sample, else 0.

    ``ann``: ``run_id`` and the key with ``af, consequence``; ``gaps``: ``run_id, feature_id, codon_start, codon_end``. Repeated keys of a sample keep the largest frequency.
    ``hits`` (``run_id`` and the key) adds ``db_hit``; with ``db_hits_only`` only mutations stay that some sample has as a hit.

    Samples are dealt to groups of about ``TOGETHER``. What a group has of a mutation, and which of it lack the place, is one row; the zeros are made at the end, where that row is. So no row grows with the
    number of samples, and only a row for each group and mutation is shuffled. Gaps stay ranges; those of a group at ``PLACES`` codons are one row.
    """
    # Dealt by mutation at once, which also serves to find the largest frequency of each sample.
    cells = mutation_cells(ann.repartition(*KEY), hits, non_synonymous_only)
    names = runs.select("run_id").distinct().persist()  # as many rows as samples; read twice
    n = names.count()
    groups = n // TOGETHER + 1
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int").alias("_group")
    mine = cells.groupBy(*KEY, group("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("run_id", F.struct("af", "hit")))).alias("found"), F.max("hit").alias("_hit"))
    own = W.partitionBy(*KEY)
    if db_hits_only:
        mine = mine.withColumn("_any", F.max("_hit").over(own)).filter("_any")
    # Each row also stands for the groups without the mutation that follow, the first for those before: so cells are read once.
    by = own.orderBy("_group")
    first, behind = F.when(F.lag("_group").over(by).isNull(), 0).otherwise(F.col("_group")), F.coalesce(F.lead("_group").over(by), F.lit(groups))
    wide = mine.withColumns({"_first": first, "_behind": behind}).withColumn("_at", F.explode(F.sequence("_first", F.col("_behind") - 1)))
    wide = wide.select(*KEY, F.col("_at").alias("_group"), F.when(F.col("_at") == F.col("_group"), F.col("found")).alias("found"), F.floor(F.col("codon_pos") / PLACES).alias("_bin"))
    bins = F.sequence(F.floor(F.col("codon_start") / PLACES), F.floor(F.col("codon_end") / PLACES))
    ranges = gaps.filter("codon_start <= codon_end").select("feature_id", group("run_id"), F.struct(F.col("run_id").alias("run"), F.col("codon_start").alias("a"), F.col("codon_end").alias("b")).alias("gap"), F.explode(bins).alias("_bin"))
    ranges = ranges.groupBy("feature_id", "_bin", "_group").agg(F.collect_list("gap").alias("gaps"))
    wide = wide.join(ranges, ["feature_id", "_bin", "_group"], "left")
    here = F.filter("gaps", lambda g: (g["a"] <= F.col("codon_pos")) & (g["b"] >= F.col("codon_pos")))
    wide = wide.withColumn("lost", F.transform(here, lambda g: g["run"])).drop("gaps", "_bin")
    own_runs = names.groupBy(group("run_id")).agg(F.collect_list("run_id").alias("runs"))
    out = wide.join(F.broadcast(own_runs) if n <= SENT else own_runs, "_group").withColumn("run_id", F.explode("runs"))
    own = F.element_at("found", F.col("run_id"))
    gap = F.coalesce(F.array_contains("lost", F.col("run_id")), F.lit(False))
    out = out.select("run_id", *KEY, F.when(own.isNotNull(), own["af"]).when(gap, F.lit(None)).otherwise(0.0).alias("cell"), F.coalesce(own["hit"], F.lit(False)).alias("db_hit"))
    return out if hits is not None else out.drop("db_hit")


def mutation_cells(ann: DataFrame, hits: DataFrame | None = None, non_synonymous_only: bool = False) -> DataFrame:
    """The cells that samples have, the form to store (M-1): ``run_id``, the key, ``af`` (the largest) and ``hit`` (true or null)."""
    found = ann.filter("consequence != 'synonymous'") if non_synonymous_only else ann
    cells = found.groupBy("run_id", *KEY).agg(F.max("af").alias("af"))
    if hits is None:
        return cells.withColumn("hit", F.lit(None).cast("boolean"))
    return cells.join(hits.select("run_id", *KEY).distinct().withColumn("hit", F.lit(True)), ["run_id", *KEY], "left")


def pivot_matrix(matrix: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each sample and a column for each of the given labels, for display."""
    return matrix.groupBy("run_id").pivot("label", labels).agg(F.first("cell"))


def shared_references(kbs: DataFrame, n: int) -> DataFrame:
    """Accessions that all n knowledge bases have (J-19)."""
    return kbs.groupBy("accession").agg(F.count_distinct("db").alias("n")).filter(F.col("n") == n).select("accession")


def compare_rules(rules: DataFrame, keys: list[str], fields: tuple[str, ...] = ("phenotype",), order: str = "rule_id") -> DataFrame:
    """For each key and database the distinct values of ``fields`` that are not blank, in the order of first appearance (A-20).

    Rules that only serve as parts of formulas are left out.
    """
    x = rules.filter(F.col("drug") != COMPONENT_DRUG)
    # One row for each value, with its first place, then the values in that order.
    parts = [x.filter(F.trim(F.col(f).cast("string")) != "").groupBy(*keys, "db", F.trim(F.col(f).cast("string")).alias("v")).agg(F.min(order).alias("_at")).withColumn("field", F.lit(f)) for f in fields]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    joined = lambda f: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == f, F.struct("_at", "v")))), lambda s: s["v"]), "; ").alias(f)
    every = x.select(*keys, "db").distinct()
    return every.join(long.groupBy(*keys, "db").agg(*map(joined, fields)), [*keys, "db"], "left").na.fill("", list(fields))


def venn(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Keys by the exact set of databases that have them (A-21)."""
    sets = rules.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("db")), "+").alias("region"))
    return sets.groupBy("region").agg(F.count("*").alias("n"))


def venn_inclusive(regions: DataFrame, dbs: list[str]) -> DataFrame:
    """For each set of databases, the keys that all of them have, no matter who else (A-21b); empty sets of keys are left out."""
    from itertools import combinations

    wanted = [("+".join(c),) for k in range(1, len(dbs) + 1) for c in combinations(sorted(dbs), k)]
    subsets = regions.sparkSession.createDataFrame(wanted, "subset string")
    pairs = subsets.crossJoin(regions).filter(F.size(F.array_except(F.split("subset", r"\+"), F.split("region", r"\+"))) == 0)
    return pairs.groupBy("subset").agg(F.sum("n").alias("n")).filter("n > 0")


def compare_counts(rules: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Distinct keys, and those that all n databases have (A-22)."""
    sets = rules.groupBy(*keys).agg(F.count_distinct("db").alias("dbs"))
    return sets.agg(F.count("*").alias("total_unique"), F.count_if(F.col("dbs") == n).alias("intersection"))
