r"""Toxicity scores from a factorization machine over hashed terms.

Terms are words and their beginnings of four and five bytes, hashed into ``2 ** BITS`` buckets; a
document has each of its terms once. A score is a bias, a weight for each term and, for each pair
of terms, the product of their factors, so that two terms together can weigh more than each
(an insult with the mention of a group). It is trained with logistic loss and AdaGrad in numpy.

Only terms that training documents of the two kinds hold unevenly take part: the chance of many
indifferent terms would else add up in long texts. A term may be uneven among all documents, or among those
that hold a term of the first kind, so that a word which says nothing alone counts where it turns another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import carried, scratch, with_row, written
from ._text import ALNUM, LOWER, Rolling, chunks, lists, mix, words

BITS = 20
FACTORS = 4
#: Labelled documents that training uses at most: those with the smallest seeded hashes of their ids.
SAMPLE = 16_000
#: Steps of training, each of 128 documents.
STEPS = 1_500
CUT = 0.7


def terms(column: pa.Array, bits: int = BITS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct buckets of the rows' terms one after the other, number of each row)."""
    for lo, hi, data, off in chunks(column):
        data = LOWER[data]
        starts, ends, before = words(data, off, ALNUM)
        rolling = Rolling(data)
        doc = np.repeat(np.arange(hi - lo), np.diff(before))
        keys = []
        for salt, size in enumerate((None, 4, 5)):
            use = slice(None) if size is None else ends - starts > size
            s, e = starts[use], ends[use]
            h = mix(rolling(s, e if size is None else s + size) + np.uint64(salt)) >> np.uint64(64 - bits)
            keys.append(doc[use].astype(np.int64) << bits | h.astype(np.int64))
        both = np.sort(np.concatenate(keys))
        if len(both):
            both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        sizes = np.bincount(both >> bits, minlength=hi - lo) if len(both) else np.zeros(hi - lo, np.int64)
        yield lo, both & ((1 << bits) - 1), sizes


def _term_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, flat, sizes in terms(batch.column(1), bits):
                scrambled = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat.astype(np.uint64)), dtype=np.uint64)))
                stop = np.cumsum(sizes)
                key = mix(scrambled[stop] - scrambled[stop - sizes]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), lists(flat.astype(np.int32), sizes, pa.int32()), pa.array(key)], ["of", "terms", "key"])

    return run


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values."""
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    stop = np.cumsum(sizes)
    return total[stop] - total[stop - sizes]


class Machine:
    """Bias, weights and factors; buckets that take part have a place, others have place -1."""

    def __init__(self, place: np.ndarray, factors: int, seed: int = 7):
        n = int(place.max()) + 1 if len(place) else 0
        self.place, self.bias, self.weight = place, 0.0, np.zeros(n)
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (n, factors))

    def raw(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.factor[at]
        total = _sums(own, sizes)
        pairs = 0.5 * (total**2 - _sums(own**2, sizes)).sum(axis=1)
        return self.bias + _sums(self.weight[at], sizes) + pairs, total

    def known(self, buckets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        use = (self.place >= 0)[buckets]
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return self.place[buckets[use]], np.bincount(row[use], minlength=len(sizes))

    def scores(self, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        raw, _ = self.raw(*self.known(buckets, sizes))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def _uneven(counts: DataFrame, bits: int, least: int) -> np.ndarray:
    """By bucket, how many deviations the labels of the documents that hold it are off those of all; 0 for buckets of fewer than ``least``.

    ``counts``: documents by ``label`` with their ``terms``. One row for each bucket comes to the driver, at most.
    """
    positive = F.sum((F.col("label") > 0).cast("long"))
    n, with_label = counts.agg(F.count("*"), F.coalesce(positive, F.lit(0))).first()
    each = counts.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), positive.alias("y")).filter(F.col("df") >= least).toArrow()
    share = max(with_label, 1.0) / max(n, 1)
    df, y = (each.column(c).to_numpy().astype(float) for c in ("df", "y"))
    z = np.zeros(1 << bits)
    z[each.column("term").to_numpy()] = (y - df * share) / np.sqrt(df * max(share * (1 - share), 0) + 1e-9)
    return z


def _filtered(flags: np.ndarray, whole: bool):
    """Documents of which some term is flagged, if ``whole``; else all with their flagged terms alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            sizes, flat = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            hit = flags[flat]
            if whole:
                yield batch.filter(pa.array(np.bincount(row[hit], minlength=len(sizes)) > 0))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(flat[hit], np.bincount(row[hit], minlength=len(sizes)), pa.int32())], batch.schema.names)

    return run


def train(labels: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, use: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Fit a machine on the buckets in ``use`` to documents given by their distinct buckets, in ``steps`` steps of 128 documents (or all, if fewer) whatever their number."""
    labels = labels.astype(float)
    n, share = len(labels), max(labels.sum(), 1.0) / max(len(labels), 1)
    place = np.full(len(use), -1, np.int64)
    place[use] = np.arange(use.sum())
    fm = Machine(place, factors)
    if not use.any():
        fm.bias = float(np.log((share + 1e-6) / (1 - share + 1e-6))) if n else 0.0
        return fm
    at, sizes = fm.known(buckets, sizes)
    first = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(11)
    sums = [1e-8, np.full(len(fm.weight), 1e-8), np.full(fm.factor.shape, 1e-8)]
    done = 0
    while done < steps:
        order = rng.permutation(n)
        for lo in range(0, n, 128)[: steps - done]:
            done += 1
            docs = order[lo : lo + 128]
            count = sizes[docs]
            stop = np.cumsum(count)
            own = at[np.repeat(first[docs] - (stop - count), count) + np.arange(stop[-1])]
            raw, total = fm.raw(own, count)
            g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[docs]) / len(docs)
            each = np.repeat(g, count)
            cells, back = np.unique(own, return_inverse=True)
            dw = np.bincount(back, weights=each, minlength=len(cells)) + decay * fm.weight[cells]
            slope = each[:, None] * (np.repeat(total, count, axis=0) - fm.factor[own])
            dv = np.column_stack([np.bincount(back, weights=slope[:, f], minlength=len(cells)) for f in range(factors)]) + decay * fm.factor[cells]
            sums[0] += g.sum() ** 2
            sums[1][cells] += dw**2
            sums[2][cells] += dv**2
            fm.bias -= rate * g.sum() / np.sqrt(sums[0])
            fm.weight[cells] -= rate * dw / np.sqrt(sums[1][cells])
            fm.factor[cells] -= rate * dv / np.sqrt(sums[2][cells])
    return fm


def held_out(doc_id: str) -> Column:
    """Rows that no training may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 3 = 1"), F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS, least: int = 3, uneven: float = 3.5) -> Machine:
    """Train on at most ``sample`` labelled rows, none of them held out. Rows without label, or with labels that differ, are not used; of an id with several texts one is.

    Terms of fewer than ``least`` of these rows, or less uneven than ``uneven`` deviations, take no part. They are counted in the tasks: what comes to
    the driver is bounded by the number of buckets, and the terms that take part by the rows of the sample, however long texts are.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    known = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample).select("doc_id", "label")
    # At most ``sample`` rows of two numbers go to the tasks, and as many lists of terms come back.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    found = rows.select(F.struct("doc_id", "label").alias("of"), "text").mapInArrow(_term_rows(bits), "of struct<doc_id:long,label:int>, terms array<int>, key long")
    one = found.groupBy("of.doc_id").agg(F.min(F.struct("of.label", "terms", "key")).alias("one"))
    with scratch(docs.sparkSession):
        table = written(one.select("one.label", "one.key", "one.terms"), "terms")
        kind = table.schema
        z = _uneven(table, bits, least)
        use = np.abs(z) >= uneven
        if (z >= uneven).any():
            # Among the documents that hold a term of the label, what tells the two kinds apart.
            use |= np.abs(_uneven(table.mapInArrow(_filtered(z >= uneven, True), kind), bits, least)) >= uneven
        rest = table.mapInArrow(_filtered(use, False), kind).toArrow().combine_chunks()
    if not rest.num_rows:
        return train(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), use)
    own = rest.column("terms").combine_chunks()
    own = own.chunk(0) if isinstance(own, pa.ChunkedArray) else own
    sizes, flat = np.diff(own.offsets.to_numpy()), own.flatten().to_numpy()
    label, key = (rest.column(c).to_numpy() for c in ("label", "key"))
    # The order of rows from executors is not fixed: sort them, so that training repeats.
    order = np.lexsort((label, key.view(np.uint64)))
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate([flat[first[i] : first[i] + sizes[i]] for i in order])
    return train((label[order] > 0).astype(float), flat, sizes[order], use)


def _score_rows(fm: Machine, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, flat, sizes in terms(batch.column(1), bits):
                rest = [c.slice(lo, len(sizes)) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(sizes)), pa.array(fm.scores(flat, sizes), pa.float64()), *rest], ["doc_id", "score", *batch.schema.names[2:]])

    return run


def score(docs: DataFrame, fm: Machine, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, cut: float = CUT, carry: bool = False) -> DataFrame:
    """Score whole texts: ``doc_id, held_out, score, predicted``, one row per input row, and with ``carry`` also the whole row as ``row``.

    Null, empty and word-less texts get the score of the bias. Equal texts get equal scores. A row may lack an id.
    Other columns are not read; an empty table gives an empty result. The machine goes to tasks with
    the code: its size is bounded by the number of buckets.
    """
    row = carried(docs) if carry else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    scored = docs.mapInArrow(_score_rows(fm, bits), with_row("doc_id long, score double", docs))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *scored.columns[2:])
