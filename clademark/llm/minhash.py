r"""MinHash near-dedup from bottom-k sketches.

One hash function orders all word shingles. A document's sketch holds its ``k``
smallest shingle hashes. Inverted lists of the retained values give candidate
overlaps, an estimate from the sketch of the union drops what is far below the
threshold, and exact Jaccard on the full sets decides.

No list is expanded into all its pairs:

* equal sets are collapsed to their smallest id before anything else;
* each list is first compared with its pivot (its smallest member) only, and the
  verified links are contracted to components;
* then only documents of lists with several components go on, with their whole sets; long lists are compared with their
  middle first, then with random members, and only documents of different components are paired, since a link inside a component changes nothing.

The middle of a list is the member of whose shingles other documents hold the largest share. In a group of copies with
changes of their own it is the text they were made from, which is like most of them, while two copies are seldom like each other.

Of a sketch of m values that must have ``need`` in common with any partner's, the
m - need + 1 that the fewest sketches hold are enough for a list, as both sides share
that order; values that no other sketch holds count among them. So a passage that many
documents share gives no candidates to a document with enough of its own. Nothing is capped.

``need`` is the exact overlap for small sets, which a sketch holds whole. For others it is
what two sets at the threshold have in common among the k smallest values of their union,
but for a probability of 1e-10 (a hypergeometric tail, see ``needs``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._components import connected_components
from ._store import dropped, scratch, written
from ._text import NOT_SPACE, chunks, gram_hashes, lists, mix, word_hashes

SKETCH = 192
MISS = 1e-10
#: Pairs of a list for each of its members up to which they are compared at once; how often lists are compared with one member at most, and the share of components
#: that must be left at most for another time.
PAIRS, TURNS, GAIN = 100, 12, 0.8


def needs(k: int, percent: int, miss: float = MISS) -> list[int]:
    """By set size, up to 16 times ``k`` (the last holds beyond): common values of two sketches, fewer of which are as unlikely as ``miss``.

    The union of a set of n values with a similar one has n to 100 * n / percent values, of which
    ``percent`` of 100 at least are common. Sketches hold a union of up to k values whole; of a
    larger one they have a sample of k, for which the largest union is the worst case.
    """
    choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    out = []
    for n in range(16 * k + 1):
        union = n * 100 // percent
        exact = -(-n * percent // 100)
        if union <= k:
            out.append(exact)
            continue
        common = -(-union * percent // 100)
        tail, least = 0.0, max(0, k - (union - common))
        while tail <= miss:
            tail += exp(choose(common, least) + choose(union - common, k - least) - choose(union, k))
            least += 1
        out.append(min(least - 1, exact))
    out[-1] = min(out[k * 2 :])
    return out


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; fewer words than ``width`` are one shingle."""
    for lo, hi, data, off in chunks(column):
        hashes, before = word_hashes(data, off, NOT_SPACE)
        grams = {w: gram_hashes(hashes, w).view(np.int64) for w in range(1, width + 1)}
        for i in range(hi - lo):
            a, b = before[i], before[i + 1]
            w = min(width, int(b - a))
            if not w:
                yield lo + i, np.zeros(0, np.int64)
                continue
            own = np.sort(grams[w][a : b - w + 1])
            first = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=first[1:])
            yield lo + i, own[first]


def _sketch_rows(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            kept: list[np.ndarray] = [np.zeros(0, np.int64)]
            for i, own in shingle_sets(batch.column(1), width):
                u = own.view(np.uint64)
                size[i] = len(own)
                one[i] = np.add.reduce(mix(u + np.uint64(1))).view(np.int64)
                two[i] = np.bitwise_xor.reduce(mix(u + np.uint64(2))).view(np.int64)
                kept.append(own[:k])
            sketch = lists(np.concatenate(kept), np.minimum(size, k), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(one), pa.array(two), sketch], ["doc_id", "n", "one", "two", "sketch"])

    return run


def _full_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, own in shingle_sets(batch.column(1), width)]
            step = max(1, len(sets) // max(1, sum(map(len, sets)) >> 20))
            for lo in range(0, len(sets), step):
                part = sets[lo : lo + step]
                full = lists(np.concatenate(part), np.array([len(x) for x in part]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, step), full], ["doc_id", "full"])

    return run


def _need(k: int, percent: int, n: Column) -> Column:
    table = needs(k, percent)
    return F.get(F.array(*map(F.lit, table)), F.least(n, F.lit(len(table) - 1)).cast("int"))


def _sizes_fit(percent: int):
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5, k: int = SKETCH
) -> DataFrame:
    """Near-duplicate components of whole texts.

    Links documents whose distinct word shingles have a Jaccard similarity of
    ``percent`` / 100 or more. Returns ``doc_id, n_shingles, component_id, kept``, one
    row per input row. Null and word-less texts have no shingles and no links; a text of
    fewer words than ``width`` is one shingle. Equal texts are linked; of repeated ids every row
    is returned. A row without id is linked with nothing: its component is null and it
    is kept. An empty table gives an empty result. Other columns are not read.
    """
    with scratch(docs.sparkSession) as kept:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        base = written(docs.mapInArrow(_sketch_rows(k, width), "doc_id long, n long, one long, two long, sketch array<long>"), "sketches")
        reps = base.filter("n > 0 and doc_id is not null").groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
        reps = written(reps, "sets")
        # Sketches are with the sets from here on.
        wide, base = base, written(base.drop("sketch"), "ids")
        dropped(wide)

        # Inverted lists of retained values that two or more different sets hold.
        entries = reps.select("rep", "n", F.explode("sketch").alias("v"))
        often = entries.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1")
        held = written(entries.join(often, "v"), "held")
        own = W.partitionBy("rep")
        ranked = held.withColumns({"r": F.row_number().over(own.orderBy("c", "v")), "h": F.count("*").over(own), "need": _need(k, percent, F.col("n"))})
        # The length of the prefix: what a value's rank must not exceed.
        inverted = written(ranked.filter("r <= h - need + 1").select("v", "rep", "n"), "inverted")
        dropped(held)

        # Whole sets of the documents that meet another in a list.
        pivots = inverted.groupBy("v").agg(F.min(F.struct("rep", "n")).alias("p"), F.count("*").alias("c")).filter("c > 1").drop("c")
        met = inverted.join(pivots, "v")
        full = docs.join(met.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        full = written(full.mapInArrow(_full_rows(width), "doc_id long, full array<long>"), "full")
        stars = met.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"), F.col("p.n").alias("na"), F.col("n").alias("nb"))
        stars = written(stars.filter("a < b").filter(_sizes_fit(percent)).distinct(), "stars")
        found = _verified(full, reps, stars, percent, k)
        groups = connected_components(found)

        # Second pass: only what is still in different components, now by the whole sets, for which the bounds are exact.
        placed = met.select("v", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("v", "rep", F.coalesce("component", "rep").alias("g"))
        placed = written(placed, "placed")
        split = placed.groupBy("v").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 != g1").select("v")
        open_ = placed.join(split, "v", "left_semi").select(F.col("rep").alias("doc_id"), "g").distinct()
        whole = full.join(open_, "doc_id").select("doc_id", "g", F.size("full").alias("n"), F.explode("full").alias("v"))
        whole = whole.join(whole.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"), "v")
        own = W.partitionBy("doc_id")
        ranked = whole.withColumns({"r": F.row_number().over(own.orderBy("c", "v")), "h": F.count("*").over(own)})
        prefix = written(ranked.filter(F.col("r") <= F.col("h") - F.ceil(F.col("n") * percent / 100) + 1), "prefix")
        # Lists are compared with one member first, the middle and then random ones, again and again while lists are long and that joins a
        # good part of what is apart: in a large group of copies, where the first pivot was like few, it soon joins nearly all.
        links, tested, apart = found, stars.select("a", "b"), None
        for turn in range(TURNS):
            lists = prefix.groupBy("v").agg(F.count("*").alias("c"), F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 != g1")
            load = lists.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("c") * (F.col("c") - 1) / 2), F.lit(0)).alias("pairs")).first()
            live = prefix.join(lists.select("v"), "v", "left_semi")
            last, apart = apart, live.select("g").distinct().count() if load["pairs"] > PAIRS * load["rows"] else 0
            if not apart or (last and apart > last * GAIN):
                break
            alone = F.lit(0) if turn else 1 - F.col("h") / F.col("n")
            pivot = live.groupBy("v").agg(F.min_by(F.struct("doc_id", "n", "g"), F.struct(alone.alias("alone"), F.xxhash64("doc_id", "v", F.lit(turn)))).alias("p"))
            near = live.join(pivot, "v").filter(F.col("g") != F.col("p.g"))
            ends = F.struct(F.col("doc_id").alias("id"), F.col("n").alias("n")), F.struct(F.col("p.doc_id").alias("id"), F.col("p.n").alias("n"))
            near = near.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
            near = written(near.filter(_sizes_fit(percent)).distinct().join(tested, ["a", "b"], "left_anti"), "near")
            tested = tested.unionByName(near.select("a", "b"))
            links = links.unionByName(_verified(full, reps, near, percent, k))
            groups = connected_components(links)
            own = groups.select(F.col("node").alias("doc_id"), F.col("component").alias("to"))
            prefix = written(prefix.join(own, "doc_id", "left").withColumn("g", F.coalesce("to", "g")).drop("to"), "prefix")

        # All pairs that are still in different components.
        live = prefix.groupBy("v").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 != g1").select("v")
        prefix = prefix.join(live, "v", "left_semi")
        side = lambda end: prefix.select("v", F.col("doc_id").alias(end), *(F.col(c).alias(c + end) for c in ("n", "g", "r", "h")))
        # A pair needs this overlap; what comes before a common value in both prefixes is not common.
        both = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
        far = (F.col("ra") <= F.col("ha") - both + 1) & (F.col("rb") <= F.col("hb") - both + 1)
        pairs = side("a").alias("x").join(side("b").alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("ga") != F.col("gb")) & (F.col("a") < F.col("b")) & _sizes_fit(percent) & far)
        across = written(pairs.select("a", "b", "na", "nb").distinct(), "across")
        more = _verified(full, reps, across.join(tested, ["a", "b"], "left_anti"), percent, k)
        groups = connected_components(links.unionByName(more))

        member = reps.select("one", "two", "n", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        member = member.select("one", "two", "n", F.coalesce("component", "rep").alias("component"))
        out = base.select("doc_id", "n", "one", "two").join(member, ["one", "two", "n"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        return kept(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "groups")


def _verified(full: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int, k: int) -> DataFrame:
    """Of candidate pairs, those whose full sets reach the threshold: ``a, b``."""
    sketch = lambda end: reps.select(F.col("rep").alias(end), F.col("sketch").alias(f"s{end}"))
    close = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    # Fewer values in the union than k: the estimate is the true similarity.
    close = close.withColumn("shared", shared).withColumn("among", F.size(union))
    exact = F.col("shared") * 100 >= F.col("among") * percent
    fits = F.when(F.col("among") < k, exact).otherwise(F.col("shared") >= _need(k, percent, F.least("na", "nb")))
    close = written(close.filter(fits).select("a", "b"), "close")
    side = lambda end: full.select(F.col("doc_id").alias(end), F.col("full").alias(f"f{end}"))
    both = close.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size("fa").alias("na"), F.size("fb").alias("nb"), F.size(F.array_intersect("fa", "fb")).alias("i"))
    return written(both.filter(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b").distinct(), "found")
