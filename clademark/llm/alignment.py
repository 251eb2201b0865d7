r"""Cross-tokenizer alignment: what two tokenizers make of the same bytes, and how many documents hold each pair of overlapping tokens.

A first pass aligns all documents and gives their distinct id pairs. A minimal perfect hash of the pairs that occur is built in shards
(levels of bits in which a key that is alone at its place is settled, the others going on); counts are dense vectors indexed by it, made by
each task for the shards it meets and summed as a tree. Keys in the order of the hash tell foreign pairs apart. A second pass aligns
documents again and looks its pairs up.

Both tokenizers begin a token at a space that follows a letter, digit or sign, so texts are cut there. A worker aligns each distinct cut
segment once and keeps the result; documents are put together from these.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import joined, scratch, written
from ._text import chunks, mix
from .packing import byte_letters, encoder

#: Pairs up to which counts go to every task (17 bytes each); beyond, pairs of documents meet their counts by a shuffle.
SENT_PAIRS = 4_000_000
#: Keys of a shard, vectors that are summed at a time, and pairs that a task holds before it passes them on.
SHARD, FAN, HELD = 1 << 16, 16, 1 << 20
#: Segments, and bytes of these, that a worker keeps.
KEPT, KEPT_BYTES = 200_000, 16 << 20
#: Bytes from which a segment is encoded alone.
LONG = 2_000
# Fixed value: what byte-level BPE cuts texts into.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes behind which a space begins a segment, whatever comes before them.
_ENDS = np.zeros(256, bool)
_ENDS[0x21:0x7F] = True
_U = np.uint64
_WIDTH = 32


def _segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """For each text with a space before it: segments before it, their number, and the segments.

    They begin at spaces behind a byte that is neither white space nor the end of such a character, whatever its plane.
    """
    n = len(off) - 1
    full, off = np.insert(data, off[:-1], 0x20), off + np.arange(n + 1)
    at = np.flatnonzero(full == 0x20)[1:]
    one, two = full[at - 1], full[np.maximum(at - 2, 0)]
    white = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (two == 0x80) | (two == 0x81) | (two == 0x9A)
    start = np.zeros(len(full), bool)
    start[at[np.where(one < 0x80, (one > 0x20) & (one < 0x7F), ~white)]] = True
    start[off[:-1]] = True
    starts = np.flatnonzero(start)
    before = np.searchsorted(starts, off)
    cuts = np.append(starts, len(full)).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(full)])
    return before[:-1], np.diff(before), held.dictionary_encode()


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


class Aligner:
    """Alignments of segments, kept by worker."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        self.path_a = path_a
        letter = byte_letters()
        with open(path_a) as f:
            vocab = json.load(f)["model"]["vocab"]
        ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if all(c in letter for c in t)}
        self.a = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(b.get_piece_size())]
        if any(b" " in x.lstrip(b" ") for x in self.b_bytes):
            raise ValueError("pieces with a space inside cross segments")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # What an id adds to the text of groups: itself and what separates it from the next.
        self.shown = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.bytes, self.texts = 0, []
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)
        self.pairs, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def codes(self, segments: pa.Array, texts: bool) -> np.ndarray:
        """The place of each segment's alignment; with ``texts``, these are made too."""
        if len(self.known) > KEPT or self.bytes > KEPT_BYTES or (texts and len(self.texts) < len(self.known)):
            self.clear()
        found = segments.to_pylist()
        self._learn([s for s in found if s not in self.known], texts)
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))

    def _ids_a(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments, one after the other, and their number. Segments that can be followed by a space go as one text."""
        alone = [i for i, s in enumerate(new) if not _ENDS[s[-1]] or len(s) > LONG]
        apart = dict.fromkeys(alone)
        for i in alone:
            text = new[i].decode()
            apart[i] = encoder(self.path_a).encode([text])[0].tolist() if len(text) > LONG else self.a.encode_ordinary(text)
        size = np.fromiter(map(len, new), np.int64, len(new))
        size[alone] = 0
        ids = np.array(self.a.encode_ordinary(b"".join(new if not alone else [s for i, s in enumerate(new) if i not in apart]).decode()), np.int64)
        cut = np.searchsorted(np.cumsum(self.a_size[ids]), np.cumsum(size), side="right")
        number = np.diff(cut, prepend=0)
        if alone:
            rest, number[alone] = _flat([apart[i] for i in alone])
            ids = np.insert(ids, np.repeat(cut[alone], number[alone]), rest)
        return ids, number

    def _learn(self, new: list[bytes], texts: bool) -> None:
        if not new:
            return
        self.known.update((s, len(self.good) + i) for i, s in enumerate(new))
        length = np.fromiter(map(len, new), np.int64, len(new))
        self.bytes += int(length.sum())
        a, n_a = self._ids_a(new)
        # A lone space ends a text; of an empty text the model would make nothing.
        lone = self.b.piece_to_id("▁")
        b, n_b = _flat([ids if s != b" " else [lone] for s, ids in zip(new, self.b.encode([s[1:].decode() for s in new], num_threads=1), strict=True)])
        whole = b"".join(new)
        good = np.ones(len(new), bool)
        for ids, number, size, table in ((a, n_a, self.a_size, self.a_bytes), (b, n_b, self.b_size, self.b_bytes)):
            stop = np.concatenate(([0], np.cumsum(number)))
            good &= np.diff(np.concatenate(([0], np.cumsum(size[ids])))[stop]) == length
            if not good.all() or b"".join(map(table.__getitem__, ids.tolist())) != whole:
                good &= np.array([b"".join(map(table.__getitem__, ids[x:y].tolist())) == s for x, y, s in zip(stop[:-1], stop[1:], new, strict=True)])
        if not good.all():
            a, b, length = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, length, 0)
            n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
        # Between two ends of either side lies one piece of text, of one token each: a link.
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        marks = np.zeros(int(length.sum()) + 1, np.int8)
        marks[end_a] = 1
        marks[end_b] += 2
        ends = np.flatnonzero(marks)
        both = np.flatnonzero(marks == 3)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        stop = np.cumsum(length)
        edge = np.concatenate(([0], np.searchsorted(ends, stop, side="right")))
        at = np.concatenate(([0], np.searchsorted(both, stop, side="right")))
        self.first = np.concatenate((self.first, len(self.pairs) + edge[:-1]))
        self.pairs = np.concatenate((self.pairs, a[in_a] << _WIDTH | b[in_b]))
        self.counts = np.concatenate((self.counts, np.column_stack((n_a, n_b, np.diff(at), np.diff(edge)))))
        self.good = np.concatenate((self.good, good))
        if texts:
            order = np.argsort(np.concatenate((np.searchsorted(both, end_a) * 2, np.searchsorted(both, end_b) * 2 + 1)), kind="stable")
            shown = np.concatenate((a * 2 + (marks[end_a] == 3), 2 * len(self.a_bytes) + b * 2 + (marks[end_b] == 3)))
            parts = list(map(self.shown.__getitem__, shown[order].tolist()))
            stop = np.cumsum(n_a + n_b).tolist()
            self.texts += ["".join(parts[lo:hi]) for lo, hi in zip([0, *stop[:-1]], stop, strict=True)]

    def links(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` each link belongs to, and its pair."""
        n = self.counts[codes, 3]
        stop = np.cumsum(n)
        return np.repeat(np.arange(len(codes)), n), self.pairs[np.repeat(self.first[codes] - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _aligned(column: pa.Array, paths: tuple[str, str], texts: bool = False) -> Iterator[tuple]:
    """(rows from, to; aligner; row and alignment of each segment of texts that have tokens; distinct alignments, and which of them a segment has)."""
    aligner = _aligner(*paths)
    for lo, hi, data, off in chunks(column, 2 << 20):
        _, number, held = _segments(data, off)
        codes = aligner.codes(held.dictionary, texts)
        which = held.indices.to_numpy()
        row = np.repeat(np.arange(hi - lo), number)
        bad = np.diff(off) == 0
        bad[row[~aligner.good[codes[which]]]] = True
        stays = ~bad[row]
        yield lo, hi, aligner, row[stays], codes, which[stays]


def _summed(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, docs = pairs[order], docs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(docs, first) if len(first) else docs


def _held(row: np.ndarray, codes: np.ndarray, which: np.ndarray, aligner: Aligner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that each row has, and how often."""
    own, times = np.unique(row * max(1, len(codes)) + which, return_counts=True)
    doc, which = own // max(1, len(codes)), own % max(1, len(codes))
    at, pairs = aligner.links(codes[which])
    distinct, code = np.unique(pairs, return_inverse=True)
    key, back = np.unique(doc[at] * max(1, len(distinct)) + code, return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, back, times[at])
    return key // max(1, len(distinct)), distinct[key % max(1, len(distinct))], n


def _distinct(row: np.ndarray, codes: np.ndarray, which: np.ndarray, aligner: Aligner) -> np.ndarray:
    """The pairs of each row, once."""
    m = max(1, len(codes))
    own = np.sort(row * m + which)
    own = own[np.diff(own, prepend=-1) > 0]
    at, pairs = aligner.links(codes[own % m])
    distinct, code = np.unique(pairs, return_inverse=True)
    key = np.sort((own // m)[at] * max(1, len(distinct)) + code)
    return distinct[key[np.diff(key, prepend=-1) > 0] % max(1, len(distinct))]


def _pair_rows(paths: tuple[str, str]):
    """Pairs and in how many documents of the task they are, in bounded parts."""

    def rows(pairs: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(mix(pairs.view(_U)).view(np.int64)), pa.array(docs)], ["pair", "h", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = docs = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, aligner, row, codes, which in _aligned(batch.column(0), paths):
                got = _distinct(row, codes, which, aligner)
                pairs, docs = _summed(np.concatenate((pairs, got)), np.concatenate((docs, np.ones(len(got), np.int64))))
                if len(pairs) > HELD:
                    yield rows(pairs, docs)
                    pairs = docs = np.zeros(0, np.int64)
        yield rows(pairs, docs)

    return run


def _place(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix(pairs.view(_U) + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _build(key: tuple, keys: pa.Table) -> pa.Table:
    """The levels of one shard and its keys in the order that they give."""
    rest = keys.column("pair").to_numpy()
    sizes, bits, order = [], [], []
    while len(rest):
        m = 2 * len(rest)
        h = (_place(rest, len(sizes)) % _U(m)).astype(np.int64)
        alone = np.bincount(h, minlength=m) == 1
        mine = alone[h]
        order.append(rest[mine][np.argsort(h[mine])])
        sizes.append(m)
        bits.append(alone)
        rest = rest[~mine]
    packed = np.packbits(np.concatenate(bits), bitorder="little").tobytes()
    kind = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())])
    return pa.table({"shard": [key[0].as_py()], "sizes": [sizes], "bits": [packed], "keys": [np.concatenate(order).tobytes()]}, kind)


class PerfectHash:
    """A number from 0, without gaps, for every key of a fixed set; foreign keys get some number or -1."""

    def __init__(self, shards: list[tuple[int, list[int], bytes]], n_shards: int):
        self.n_shards = n_shards
        depth = max((len(s[1]) for s in shards), default=0)
        self.sizes, self.base = np.zeros((n_shards, depth), np.int64), np.zeros((n_shards, depth), np.int64)
        flags, total = [np.zeros(0, bool)], 0
        for shard, sizes, bits in sorted(shards):
            self.sizes[shard, : len(sizes)] = sizes
            self.base[shard, : len(sizes)] = total + np.cumsum([0, *sizes[:-1]])
            flags.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes), bitorder="little").view(bool))
            total += sum(sizes)
        flat = np.concatenate([*flags, np.zeros(-total % 64, bool)])
        self.words = np.packbits(flat, bitorder="little").view("<u8")
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def shard(self, pairs: np.ndarray) -> np.ndarray:
        return np.mod(mix(pairs.view(_U)).view(np.int64), self.n_shards)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        out, live, shard = np.full(len(pairs), -1, np.int64), np.arange(len(pairs)), self.shard(pairs)
        for level in range(self.sizes.shape[1]):
            live = live[self.sizes[shard[live], level] > 0]
            own = shard[live]
            at = self.base[own, level] + (_place(pairs[live], level) % self.sizes[own, level].astype(_U)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(_U)
            hit = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1))).astype(np.int64)
            out[live[hit]] = self.rank[at[hit] >> 6] + below[hit]
            live = live[~hit]
        return out


def _vector_rows(shared, offsets: np.ndarray):
    """Dense counts of a task by shard, for the shards that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, node = shared.value, TaskContext.get().partitionId()
        counts = np.zeros(offsets[-1], np.int64)
        for batch in batches:
            np.add.at(counts, perfect(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        for shard, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if counts[lo:hi].any():
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([node], pa.int32()), pa.array([counts[lo:hi].tobytes()])], ["shard", "node", "counts"])

    return run


def _add(key: tuple, vectors: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in vectors.column("counts"))
    kind = pa.schema([("shard", pa.int32()), ("node", pa.int32()), ("counts", pa.binary())])
    return pa.table({"shard": [key[0].as_py()], "node": [key[1].as_py()], "counts": [total.tobytes()]}, kind)


class Counts:
    """In how many documents each pair is, and whether no other pair with its first id is in more."""

    def __init__(self, perfect: PerfectHash, keys: np.ndarray, docs: np.ndarray):
        self.perfect, self.keys, self.docs = perfect, keys, docs
        first = keys >> _WIDTH
        best = np.zeros(int(first.max()) + 1 if len(first) else 0, np.int64)
        np.maximum.at(best, first, docs)
        self.best = docs == best[first]

    def __call__(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.perfect(pairs)
        if len(pairs) and ((at < 0).any() or (self.keys[at] != pairs).any()):
            raise ValueError("a pair that the first pass has not seen: the documents have changed")
        return self.docs[at], self.best[at]


def _counts(spark: SparkSession, partial: DataFrame, keys: DataFrame, n: int) -> Counts:
    n_shards = n // SHARD + 1
    shard = F.pmod("h", F.lit(n_shards)).cast("int").alias("shard")
    built = keys.select("pair", shard).groupBy("shard").applyInArrow(_build, "shard int, sizes array<long>, bits binary, keys binary").collect()
    perfect = PerfectHash([(x.shard, list(x.sizes), bytes(x.bits)) for x in built], n_shards)
    by_shard = {x.shard: np.frombuffer(bytes(x.keys), np.int64) for x in built}
    none = np.zeros(0, np.int64)
    offsets = np.cumsum([0, *(len(by_shard.get(s, none)) for s in range(n_shards))])
    vectors = partial.select("pair", "docs")
    left = vectors.rdd.getNumPartitions()
    vectors = vectors.mapInArrow(_vector_rows(spark.sparkContext.broadcast(perfect), offsets), "shard int, node int, counts binary")
    while left > 1:
        left = -(-left // FAN)
        vectors = vectors.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node").applyInArrow(_add, "shard int, node int, counts binary")
    docs = {x.shard: np.frombuffer(bytes(x.counts), np.int64) for x in vectors.collect()}
    flat = lambda parts: np.concatenate([none, *(parts.get(s, none) for s in range(n_shards))])
    return Counts(perfect, flat(by_shard), flat(docs))


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"


def _doc_rows(paths: tuple[str, str], shared=None):
    """A row for each document: with the counts of its links, or with its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, aligner, row, codes, which in _aligned(batch.column(1), paths, texts=True):
                n = hi - lo
                segment = codes[which]
                edge = np.searchsorted(row, np.arange(n + 1))
                parts = np.zeros((n, 4), np.int64)
                np.add.at(parts, row, aligner.counts[segment])
                shown = list(map(aligner.texts.__getitem__, segment.tolist()))
                texts = ["".join(shown[a:b])[:-1] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                del shown
                columns = [batch.column(0).slice(lo, n), *(pa.array(parts[:, i]) for i in range(4)), pa.array(texts, pa.string())]
                names = [x.split()[0] for x in _DOC.split(", ")]
                if shared is None:
                    doc, pairs, times = _held(row, codes, which, aligner)
                    offsets = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                    held = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])
                    yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, held)], [*names, "pairs"])
                    continue
                at, pairs = aligner.links(codes)
                used = np.zeros(len(codes), bool)
                used[which] = True
                at, pairs = at[used[at]], pairs[used[at]]
                docs, best = shared.value(pairs)
                sums = np.zeros((len(codes), 2), np.int64)
                np.add.at(sums, at, np.column_stack((best, docs)))
                own = np.zeros((n, 2), np.int64)
                np.add.at(own, row, sums[which])
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 0]), pa.array(own[:, 1])], [*names, "n_best", "count_sum"])

    return run


def align(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", sent_pairs: int | None = None) -> DataFrame:
    """Alignment of the tokens that two tokenizers give each text, with the document counts of linked id pairs.

    ``tokenizer_a``: a byte-level BPE file of the tokenizers library, which reads a space and the text; ``tokenizer_b``: a sentencepiece BPE model
    that adds this space itself; both paths hold on every machine. Special tokens' strings in a text are plain text. Byte offsets where tokens of both end cut them into groups;
    tokens whose bytes overlap are linked. A pair's count is the number of documents that have it linked. Returns ``doc_id, n_a, n_b, n_groups, n_links``,
    ``groups`` (``a1,a2|b1;a3|b2,b3``), ``n_best`` (links whose count is the highest of their A id, ties included) and ``count_sum`` (over links).

    A text that is null or empty, or that the pieces of either do not give back, has no tokens: zeros and ``''``. Every row is a document of its own, also if
    ids or rows are repeated or null. Other columns are not read; an empty table gives an empty result.

    Up to ``sent_pairs`` (``SENT_PAIRS``) distinct pairs, their counts go to every task; beyond, they meet the documents' pairs by a shuffle, with the same result.
    """
    spark, paths = docs.sparkSession, (tokenizer_a, tokenizer_b)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(spark) as kept:
        partial = written(docs.select("text").mapInArrow(_pair_rows(paths), "pair long, h long, docs long"), "partial")
        keys = written(partial.select("pair", "h").distinct(), "keys")
        n = keys.count()
        if n <= (SENT_PAIRS if sent_pairs is None else sent_pairs):
            counts = spark.sparkContext.broadcast(_counts(spark, partial, keys, n))
            return docs.mapInArrow(_doc_rows(paths, counts), _DOC + ", n_best long, count_sum long")
        counted = written(partial.groupBy("pair").agg(F.sum("docs").alias("docs")), "counts").withColumn("a", F.shiftright("pair", _WIDTH))
        best = counted.groupBy("a").agg(F.max("docs").alias("best"))
        table = written(counted.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("best")).cast("long").alias("top")), "table")
        rows = docs.mapInArrow(_doc_rows(paths), _DOC + ", pairs array<struct<pair: long, n: long>>").withColumn("row", F.monotonically_increasing_id())
        rows = kept(rows, "rows")
        met = joined(rows.select("row", F.inline("pairs")), table, ["pair"], "docs").groupBy("row")
        sums = kept(met.agg(F.sum(F.col("n") * F.col("top")).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")), "sums")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("pairs").join(sums, "row", "left").select(*(x.split()[0] for x in _DOC.split(", ")), zero("n_best"), zero("count_sum"))
