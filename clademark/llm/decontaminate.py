r"""Benchmark decontamination by winnowing.

Training and test texts are cut into words. Of every window of consecutive k-gram
hashes the smallest is a fingerprint, so that any shared span of ``window`` words has a
fingerprint in common. Fingerprints of both sides are joined, and every common one is
extended on both sides along its diagonal, as far as a window that holds it reaches; runs of a whole window
or more mark the document's words.

Items shorter than the window are one window themselves. Their grams are as long as the
item (one fingerprint), kept apart by length, and documents give all grams of those
lengths that some item has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import carried, with_row, written
from ._text import ALNUM, chunks, gram_hashes, mix, word_hashes

WINDOW = 13
GRAM = 8
#: Words of all test items up to which they are sent to every task; beyond, fingerprints are joined by a shuffle.
BROADCAST_WORDS = 1_000_000
#: Words of items that one row of the shuffle path holds at most, but for a single longer item; a document that meets more has several rows.
PART_WORDS = 1_000_000
#: Pairs of places of a document and of items that are compared at a time.
PAIRS = 1_000_000


def fingerprints(words: np.ndarray, gram: int, window: int) -> np.ndarray:
    """Positions of the winnowed grams of one text: the first smallest of each run of ``window - gram + 1``."""
    hashes = gram_hashes(words, gram)
    span = window - gram + 1
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, span)
    return np.unique(runs.argmin(axis=1) + np.arange(len(runs)))


class Items:
    """Test items by id, with their fingerprints sorted by (gram length, hash).

    Of fingerprints of one item with the same words around them, as far as a window can reach, one is kept: the others would mark the same words.
    """

    def __init__(self, ids: list, words: list[np.ndarray], gram: int, window: int):
        self.ids, self.gram, self.window = ids, gram, window
        self.off = np.cumsum([0, *map(len, words)])
        self.flat = np.concatenate([*words, np.zeros(0, np.uint64)])
        by: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for n, w in enumerate(words):
            size = min(len(w), window)
            if size:
                at = fingerprints(w, gram, window) if size == window else np.zeros(1, np.int64)
                width = gram if size == window else size
                by.setdefault(width if size < window else 0, []).append((gram_hashes(w, width)[at], np.full(len(at), n), at + self.off[n]))
        self.tables = {}
        for width, parts in by.items():
            h, n, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not width:
                around = n.astype(np.uint64)
                for i in range(gram - window, window):
                    inside = (at + i >= self.off[n]) & (at + i < self.off[n + 1])
                    around = mix(around * np.uint64(3) + np.where(inside, self.flat[np.where(inside, at + i, 0)], np.uint64(i + window)))
                first = np.sort(np.unique(around, return_index=True)[1])
                h, n, at = h[first], n[first], at[first]
            order = np.argsort(h, kind="stable")
            self.tables[width] = (h[order], n[order], at[order])

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """Flags of the words of a document that are in occurring windows, and the ids of the items that have some.

        A fingerprint in common is extended on both sides as far as a window that holds it can reach; every shared window has one.
        """
        edge, found = np.zeros(len(words) + 1, np.int64), set()
        for width, (keys, owner, where) in self.tables.items():
            size = width or self.gram
            if width:
                at = np.arange(max(0, len(words) - width + 1))
                hashes = gram_hashes(words, width)
            else:
                at = fingerprints(words, self.gram, self.window)
                hashes = gram_hashes(words, self.gram)[at]
            lo = np.searchsorted(keys, hashes, "left")
            count = np.searchsorted(keys, hashes, "right") - lo
            some = np.flatnonzero(count)
            # A bounded number of pairs of places at a time.
            block = np.cumsum(count[some]) // PAIRS
            for part in np.split(some, np.flatnonzero(np.diff(block)) + 1) if len(some) else ():
                c = count[part]
                rows = np.repeat(lo[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                a, p, n = np.repeat(at[part], c), where[rows], owner[rows]
                same = np.ones(len(a), bool)
                for i in range(size):
                    same &= words[a + i] == self.flat[p + i]
                a, p, n = a[same], p[same], n[same]
                side = 0 if width else self.window - self.gram
                left = self._reach(words, a, p, n, -1, side)
                right = self._reach(words, a + size - 1, p + size - 1, n, 1, side)
                good = left + size + right >= (width or self.window)
                np.add.at(edge, (a - left)[good], 1)
                np.add.at(edge, (a + size + right)[good], -1)
                found.update(np.unique(n[good]).tolist())
        return np.cumsum(edge[:-1]) > 0, list({self.ids[n] for n in found})

    def _reach(self, words: np.ndarray, a: np.ndarray, p: np.ndarray, n: np.ndarray, step: int, most: int) -> np.ndarray:
        """How many words beyond places ``a`` and ``p`` are equal, up to ``most``, inside the document and the item."""
        far, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for i in range(1, most + 1):
            x, y = a[live] + i * step, p[live] + i * step
            live = live[(x >= 0) & (x < len(words)) & (y >= self.off[n[live]]) & (y < self.off[n[live] + 1])]
            live = live[words[a[live] + i * step] == self.flat[p[live] + i * step]]
            far[live] = i
        return far


def _row(n_words: int, hit: np.ndarray, found: list) -> tuple[int, int, int, str]:
    names = sorted(str(x) for x in found)
    return n_words, int(hit.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]


def _scan(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi, data, off in chunks(batch.column(1)):
                hashes, before = word_hashes(data, off, ALNUM)
                for i in range(hi - lo):
                    own = hashes[before[i] : before[i + 1]]
                    rows.append(_row(len(own), *items.hits(own)))
            yield _batch(batch, rows)

    return run


def _batch(given: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    rest = [n for n in given.schema.names if n == "row"]
    return pa.RecordBatch.from_arrays([given.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), *map(given.column, rest)], [*_NAMES, *rest])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own: list[np.ndarray] = []
        for lo, hi, data, off in chunks(batch.column(1)):
            hashes, before = word_hashes(data, off, ALNUM)
            own += [hashes.view(np.int64)[before[i] : before[i + 1]] for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], ["item_id", "words"])


def _grams(gram: int, window: int, short: list[int]):
    """(key of the text, fingerprint) of documents: winnowed grams and all grams of the short items' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(1)):
                hashes, before = word_hashes(data, off, ALNUM)
                ids, keys = [], []
                for i in range(hi - lo):
                    own = hashes[before[i] : before[i + 1]]
                    parts = [gram_hashes(own, gram)[fingerprints(own, gram, window)], *(gram_hashes(own, w) for w in short)]
                    one = np.unique(np.concatenate(parts).view(np.int64))
                    ids.append(np.full(len(one), lo + i))
                    keys.append(one)
                take = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(keys))], ["text_key", "key"])

    return run


def _item_keys(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items = Items([i], [np.array(own, np.int64).view(np.uint64)], gram, window)
                for h, _, _ in items.tables.values():
                    one = np.unique(h.view(np.int64))
                    ids += [i] * len(one)
                    keys.append(one)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat)], ["item_key", "key"])

    return run


def _own_items(gram: int, window: int):
    """For each text and some items that have a fingerprint in common with it: runs of hit words, and the items that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, names = [], []
            ids, words = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, data, off in chunks(batch.column(1)):
                hashes, before = word_hashes(data, off, ALNUM)
                for i in range(hi - lo):
                    items = Items([x["item_id"] for x in ids[lo + i]], [np.array(w, np.int64).view(np.uint64) for w in words[lo + i]], gram, window)
                    hit, found = items.hits(hashes[before[i] : before[i + 1]])
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    spans.append(edges.tolist())
                    names.append([str(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))], ["text_key", "edges", "names"])

    return run


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the runs and items of all parts of its text."""
    for batch in batches:
        rows = []
        edges, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for lo, hi, data, off in chunks(batch.column(1)):
            hashes, before = word_hashes(data, off, ALNUM)
            for i in range(hi - lo):
                hit = np.zeros(int(before[i + 1] - before[i]), bool)
                own = edges[lo + i] or []
                for x, y in zip(own[::2], own[1::2], strict=True):
                    hit[x:y] = True
                rows.append(_row(len(hit), hit, list(set(names[lo + i] or []))))
        yield _batch(batch, rows)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    window: int = WINDOW, gram: int = GRAM, share: int = 20, broadcast_words: int = BROADCAST_WORDS, carry: bool = False, part_words: int = PART_WORDS,
) -> DataFrame:
    """How much of each document occurs in test items.

    Returns ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, one row per
    input row (with ``carry`` also the whole row as ``row``): words, words in an occurrence of an item's window, items with such windows,
    the hash of their ids, and whether hits are at least one word in ``share``. Null or
    word-less texts and items have nothing; no items find the hash of an empty string;
    repeated rows each give a row. Repeated item ids count once. Other columns are not read. An id may be null;
    items without id count as one item.

    Test items of up to ``broadcast_words`` words in all (counted first) go to every task. Beyond,
    fingerprints are joined by a shuffle and each text gets the items it meets, in parts of about ``part_words`` words. Texts and
    items are known there by hashes of what they hold, not by their ids.
    """
    row = carried(docs) if carry else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *row)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = written(items.mapInArrow(_item_words, "item_id long, words array<long>").filter("size(words) > 0"), "items")
    total = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    if total <= broadcast_words:
        rows = items.collect()
        known = Items([r.item_id for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], gram, window)
        out = docs.mapInArrow(_scan(known), with_row(RESULT, docs))
    else:
        short = [r.n for r in items.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect()]
        docs = docs.withColumn("text_key", F.sha2("text", 256))
        texts = docs.filter("text is not null").select("text_key", "text")
        # Items of equal hashes go together: more items than a text meets change nothing, as each is verified.
        items = items.withColumn("item_key", F.xxhash64("words"))
        key = texts.mapInArrow(_grams(gram, window, sorted(short)), "text_key string, key long")
        keys = items.select("item_key", "words").mapInArrow(_item_keys(gram, window), "item_key long, key long").distinct()
        meets = written(key.join(keys, "key").select("text_key", "item_key").distinct(), "meets")
        sizes = items.groupBy("item_key").agg(F.sum(F.size("words")).alias("n"))
        parts = meets.join(sizes, "item_key").groupBy("text_key").agg(F.ceil(F.sum("n") / part_words).alias("parts"))
        dealt = meets.join(parts, "text_key").join(items, "item_key").withColumn("part", F.expr("pmod(xxhash64(item_key, item_id), parts)"))
        own = dealt.groupBy("text_key", "part").agg(F.collect_list(F.struct("item_id", "words")).alias("items"))
        own = own.select("text_key", F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"))).alias("ids"), F.col("items.words").alias("words"))
        scanned = texts.join(meets.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"]).join(own, "text_key")
        found = scanned.select("text_key", "text", "ids", "words").mapInArrow(_own_items(gram, window), "text_key string, edges array<long>, names array<string>")
        found = found.groupBy("text_key").agg(F.flatten(F.collect_list("edges")).alias("edges"), F.flatten(F.collect_list("names")).alias("names"))
        rest = ["row"] * carry
        out = docs.join(found, "text_key", "left").select("doc_id", "text", "edges", "names", *rest).mapInArrow(_united, with_row(RESULT, docs))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))
