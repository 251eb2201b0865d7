r"""Embedding near-dedup by an exact metric range join.

A cosine of at least ``cosine`` between unit vectors is a distance of at most
``r = sqrt(2 - 2 * cosine)``. Vectors of one label go to the cell of their nearest pivot. If x is in
cell c and y within r of x, then d(y, c) <= d(y, own) + 2r by the triangle inequality, so y is
copied to the cells where that holds, and every cell finds all partners of its own vectors alone. A
cell beyond ``block`` vectors is split into pairs of blocks.

Equal vectors of a label are collapsed to one with its smallest id and a count first. A task returns, for each of its
vectors, how many it is linked with and a link to the smallest vector that it reaches in the task,
never all pairs.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import scratch, written

COSINE = 0.93
BLOCK = 3_000
#: Vectors of a label for each pivot, while that gives fewer pivots than the root of their number.
PER_PIVOT = 2_000
#: Vectors of a label that are placed in one task.
PER_TASK = 20_000


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_PLACED = ["label", "dim", "cell", "home", "id", "m", "v"]


def _place(radius: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            cell = np.zeros(left.num_rows, np.int64) - 1
            take, home = np.arange(left.num_rows), np.ones(left.num_rows, bool)
        else:
            x, p = _matrix(left.column("v"), left.num_rows), _matrix(right.column("v"), right.num_rows)
            ids = right.column("id").to_numpy()
            order = np.argsort(ids)
            p, ids = p[order], ids[order]
            parts = []
            for lo in range(0, len(x), 2000):
                d = np.sqrt(np.maximum(0, 2 - 2 * (x[lo : lo + 2000] @ p.T)))
                own = d.argmin(axis=1)
                near = d <= d[np.arange(len(d)), own][:, None] + 2 * radius + 1e-6
                row, at = np.nonzero(near)
                parts.append((row + lo, ids[at], at == own[row]))
            take, cell, home = (np.concatenate(c) for c in zip(*parts, strict=True))
        rows = left.take(pa.array(take))
        return pa.table([rows.column("label"), rows.column("dim"), pa.array(cell), pa.array(home), rows.column("id"), rows.column("m"), rows.column("v")], names=_PLACED)

    return run


def _join(cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        ids, m, role = (rows.column(c).to_numpy() for c in ("id", "m", "role"))
        v = _matrix(rows.column("v"), len(ids))
        nodes, at = np.unique(ids, return_inverse=True)
        left, right = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        links = np.zeros(len(left), np.int64)
        label = np.arange(len(nodes))
        masks = []
        for lo in range(0, len(left), 500):
            part = left[lo : lo + 500]
            c = v[part] @ v[right].T
            hit = c >= cosine
            tie = np.argwhere(np.abs(c - cosine) < 1e-12)
            for i, j in tie:
                hit[i, j] = float(np.dot(v[part[i]], v[right[j]])) >= cosine
            hit &= ids[part][:, None] != ids[right][None]
            links[lo : lo + 500] = hit @ m[right]
            masks.append((at[part], np.packbits(hit, axis=1)))
        far = len(nodes)
        while True:
            old = label.copy()
            for part, packed in masks:
                hit = np.unpackbits(packed, axis=1, count=len(right)).astype(bool)
                low = np.minimum(label[part], np.where(hit, label[at[right]][None], far).min(axis=1, initial=far))
                np.minimum.at(label, part, low)
                np.minimum.at(label, at[right], np.where(hit, low[:, None], far).min(axis=0, initial=far))
            label = label[label]
            if (label == old).all():
                break
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        own = ids[left]
        return pa.table({"id": np.concatenate((own, nodes[moved])), "links": np.concatenate((links, np.zeros(len(moved), np.int64))), "root": np.concatenate((own, nodes[label[moved]]))})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK, per_pivot: int = PER_PIVOT) -> DataFrame:
    """Links of vectors with equal labels and a cosine of at least ``cosine``, and their components.

    Returns ``vec_id, n_links, component_id, kept``, one row per input row: other vectors linked directly, the smallest
    id reachable, and whether that is the row's own. Vectors that are null, empty, all zero or hold null or
    non-finite numbers, and rows without id or label, have no links; without id the component is null and the row is kept. Vectors of different lengths are not
    linked. Vectors are known by label and value, ids only name them: a repeated row, or another vector with the same id, is a vector of its own. Labels may be of any type. Other columns are not read.
    """
    kind = vectors.schema[label_col].dataType.simpleString()
    # Cosines are of double precision; vectors of floats are moved as such.
    number = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    with scratch(vectors.sparkSession) as kept:
        rows = vectors.select(F.col(id_col).cast("long").alias("named"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("v"))
        fine = F.expr("named is not null and label is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
        good = rows.filter(fine).withColumn("dim", F.size("v"))
        classes = good.groupBy("label", "dim", "v").agg(F.min("named").alias("named"), F.count("*").alias("m"))
        classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        # One row for each label.
        many = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
        sized = classes.join(many, ["label", "dim"])
        # Placing costs vectors times pivots, so pivots grow as the root of the vectors at last, and cells with them.
        wanted = F.floor(F.least(F.col("n") / per_pivot, F.sqrt(F.col("n").cast("double")))) + 1
        salts = (F.floor(F.col("n") / PER_TASK) + 1).cast("int")
        pivots = sized.filter(F.pmod(F.xxhash64("id", F.lit(31)), F.col("n")) < wanted).select("label", "dim", "id", "v", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        pivots = written(pivots, "pivots")
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(32)), salts).cast("int")).select("label", "dim", "id", "m", "v", "salt")
        keys = ["label", "dim", "salt"]
        radius = sqrt(2 - 2 * cosine)
        placed = written(salted.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInArrow(_place(radius), f"label {kind}, dim int, cell long, home boolean, id long, m long, v array<{number}>"), "placed")
        cells = placed.groupBy("label", "dim", "cell").agg((F.floor(F.count("*") / block) + 1).cast("int").alias("blocks"))
        spread = placed.join(cells, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("id", F.lit(33)), F.col("blocks")).cast("int"))
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        names = ["label", "dim", "cell", "id", "m", "v"]
        one = spread.filter("home").select(*names, F.lit(0).alias("role"), F.col("own").alias("i"), each.alias("j"))
        two = spread.select(*names, F.lit(1).alias("role"), each.alias("i"), F.col("own").alias("j"))
        found = written(one.unionByName(two).groupBy("label", "dim", "cell", "i", "j").applyInArrow(_join(cosine), "id long, links long, root long"), "found")
        counts = found.groupBy("id").agg(F.sum("links").alias("links"))
        groups = connected_components(found.filter("id != root"), "id", "root")
        known = classes.join(counts, "id").join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        least = known.groupBy("component").agg(F.min("named").alias("least"))
        known = known.join(least, "component").select("label", "dim", "v", (F.col("m") - 1 + F.col("links")).alias("links"), "least")
        out = rows.withColumn("dim", F.when(fine, F.size("v"))).join(known, ["label", "dim", "v"], "left")
        out = out.select(F.col("named").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "named").alias("component_id"))
        return kept(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "groups")
