r"""Harmonic packing of token pieces into sequences.

Piece lengths fall into reciprocal-capacity classes: one of more than 1024 / (j + 1) and at most 1024 / j tokens is of class
j, whose bins take j pieces each, whatever their lengths. A document is cut into whole sequences and its
remainder, and the remainder only where its class would waste more than ``WASTE`` tokens: then a piece of the full length of the next class
is cut off first. So a document has few pieces, hardly any of them short, and a full bin little padding. Every worker keeps one
open bin for each class and shares nothing; what is open at its end is put together longest first.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, mix

CAPACITY = 1024
END_ID = 0
#: Tokens that a piece may fall short of its class's length before it is cut, and the shortest piece that is cut off.
WASTE, LEAST = 24, 32
#: Distinct pre-token ids kept by a worker; when full, it starts again.
CACHE_WORDS = 1_000_000

#: Letters, numbers, white space and the rest of the code points that are classified here; a text with others
#: goes to the tokenizer whole.
_KNOWN = 0x0590
_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0)
_CLASS = np.array([2 if i in _SPACE else {"L": 0, "N": 1}.get(unicodedata.category(chr(i))[0], 3) for i in range(_KNOWN)], np.uint8)
_ASSIGNED = np.array([unicodedata.category(chr(i)) != "Cn" for i in range(_KNOWN)])
_CODE = mix(np.arange(11, _KNOWN + 11, dtype=np.uint64))


def word_starts(code: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of where the pre-tokens of byte-level BPE begin.

    They are runs of letters, numbers or other signs, each with one space before it; the
    contractions 's 't 're 've 'm 'll 'd; and runs of white space without the last character
    if something follows.
    """
    n = len(code)
    kind = _CLASS[code]
    new = np.zeros(n + 1, bool)
    new[off] = True
    start = new[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    joined = np.zeros(n, bool)
    joined[1:] = (code[:-1] == 0x20) & (kind[1:] != 2) & ~new[1:n]
    start &= ~joined
    # The last of a run of white space, if something follows.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == 2) & (kind[1:] != 2) & ~new[1:n]
    start |= last
    # Contractions: an apostrophe that starts a pre-token, with letters right behind.
    mark = np.flatnonzero((code == 0x27) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == 0) & ~new[mark + 1]]
    if len(mark):
        one = code[mark + 1]
        two = np.where((mark + 2 < n) & ~new[np.minimum(mark + 2, n)], code[np.minimum(mark + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = np.zeros(len(mark), bool)
        for pair in ("re", "ve", "ll"):
            double |= (one == ord(pair[0])) & (two == ord(pair[1]))
        size = np.where(single, 1, np.where(double, 2, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        start[after[after < n]] = True
    return start


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, else the next free one from 256."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of whole texts, with the ids of known pre-tokens kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import tiktoken

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # The same vocabulary for single pre-tokens: ids are ranks of merges.
        letter = byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letter for c in t)}
        self.core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.clear()

    def clear(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        odd = [len(c) > 0 and (c.max() >= _KNOWN or not _ASSIGNED[c].all()) for c in codes]
        whole = iter(self.plain([t for t, o in zip(texts, odd, strict=True) if o]))
        known = iter(self._encode([c for c, o in zip(codes, odd, strict=True) if not o]))
        return [np.array(next(whole), np.uint32) if o else next(known) for o in odd]

    def _encode(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        off = np.cumsum([0, *map(len, codes)])
        if not off[-1]:
            return [np.zeros(0, np.uint32) for _ in codes]
        code = np.concatenate(codes)
        starts = np.flatnonzero(word_starts(code, off))
        ends = np.append(starts[1:], len(code))
        # Pre-tokens are short: hash them character by character.
        size = ends - starts
        key = mix(size.astype(np.uint64) + np.uint64(0xABCDEF))
        live = np.arange(len(starts))
        for i in range(int(size.max())):
            key[live] = (key[live] ^ _CODE[code[starts[live] + i]]) * np.uint64(0x9FB21C651E98DF25)
            key[live] ^= key[live] >> np.uint64(29)
            live = live[size[live] > i + 1]
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        self._learn(distinct, [code[starts[w] : ends[w]] for w in where[~np.isin(distinct, self.keys, assume_unique=True)]])
        at = np.searchsorted(self.keys, distinct)[back]
        first, count = self.first[at], self.count[at]
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(first - (stop - count), count) + np.arange(stop[-1])]
        cuts = np.concatenate(([0], stop))[np.searchsorted(starts, off)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, distinct: np.ndarray, words: list[np.ndarray]) -> None:
        if not words:
            return
        fresh = distinct[~np.isin(distinct, self.keys, assume_unique=True)]
        got = [self.core.encode_single_piece(w.tobytes().decode("utf-32-le").encode()) for w in words]
        count = np.array([len(x) for x in got])
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate((self.flat, np.array([i for x in got for i in x], np.uint32)))
        keys = np.concatenate((self.keys, fresh))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], np.concatenate((self.first, first))[order], np.concatenate((self.count, count))[order]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    found = _encoders[path]
    if len(found.keys) > CACHE_WORDS:
        found.clear()
    return found


class Bins:
    """Open bins of one worker, by class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open, self.out = capacity, first_id, {}, []

    def add(self, length: int, row: tuple) -> None:
        count = self.capacity // length
        bin_ = self.open.setdefault(count, [])
        bin_.append((length, row))
        if len(bin_) == count:
            self._close(bin_)
            self.open[count] = []

    def _close(self, pieces: list[tuple[int, tuple]]) -> None:
        offset = 0
        for length, row in pieces:
            self.out.append((*row, self.next, offset))
            offset += length
        self.next += 1

    def finish(self) -> None:
        """Put what is left in the fewest sequences that taking the longest first gives."""
        left = sorted((x for pieces in self.open.values() for x in pieces), key=lambda x: -x[0])
        room: list[int] = []
        bins: list[list[tuple[int, tuple]]] = []
        for piece in left:
            i = next((i for i, r in enumerate(room) if r >= piece[0]), len(room))
            if i == len(room):
                room.append(self.capacity)
                bins.append([])
            room[i] -= piece[0]
            bins[i].append(piece)
        for pieces in bins:
            self._close(pieces)
        self.open = {}


def cuts(tokens: int, capacity: int, waste: int = WASTE, least: int = LEAST) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then full lengths of classes while the rest would waste more than ``waste`` tokens.

    Nothing shorter than ``least`` is cut off; the piece before it is shortened instead.
    """
    out, rest = [capacity] * (tokens // capacity), tokens % capacity
    while rest:
        count = capacity // rest
        if capacity // count - rest <= waste or rest <= 2 * least:
            return [*out, rest]
        piece = min(capacity // (count + 1), rest - least)
        out.append(piece)
        rest -= piece
    return out


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack_rows(path: str, capacity: int, with_ids: bool):
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def rows_of(bins: Bins) -> pa.RecordBatch:
        columns = list(zip(*bins.out, strict=True)) or [[]] * 8
        bins.out = []
        d, start, length, crc, total, ids, seq, offset = columns
        kept = [pa.array(c, pa.int64()) for c in (d, start, length, crc, total, seq, offset)]
        return pa.RecordBatch.from_arrays(kept + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            keys, column = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi, _, _ in chunks(column, 4 << 20):
                texts = column.slice(lo, hi - lo).fill_null("").to_pylist()
                for key, ids in zip(keys[lo:hi], encoder(path).encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for length in cuts(len(ids), capacity):
                        piece = ids[start : start + length]
                        bins.add(length, (key, start, length, zlib.crc32(piece), len(ids), piece.tolist() if with_ids else None))
                        start += length
                yield rows_of(bins)
        bins.finish()
        yield rows_of(bins)

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack whole documents, tokenized, into sequences of at most ``capacity`` tokens.

    ``tokenizer``: path of a byte-level BPE file of the tokenizers library, on every machine. Each
    document ends with id 0. Returns a row for each piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset`` and, with ``with_ids``, its ``ids``. Null text is empty: one piece
    with the end id. Strings of special tokens in a text are ordinary text, as the tokenizers' notes advise. Repeated rows are packed each; an id may be null; an empty table gives an
    empty result; other columns are not read. Nothing is shuffled.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_pack_rows(tokenizer, capacity, with_ids), _SCHEMA + ", ids array<int>" * with_ids)
