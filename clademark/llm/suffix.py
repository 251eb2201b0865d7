r"""Removal of long strings that occur more than once, by backward extension on a BWT.

A string of ``length`` bytes (a window) is repeated if it starts at another place of the
corpus too. Each window has an anchor: the smallest of the hashes of its ``gram``-byte
substrings. Equal windows have equal anchors at equal offsets, so windows are compared
inside the group of an anchor only. Consecutive windows of a text with the same anchor
occurrence are one piece of text, and equal pieces of an anchor are collapsed to one with a
count first: what occurs twice whole is repeated whole.

Within an anchor's group the suffixes that start at the anchor are sorted once and have
the common prefixes of neighbours. Then all groups of a task are extended backward one byte
at a time, breadth first: prepending the preceding bytes (the Burrows-Wheeler column) and a stable
sort by that byte give the order of the longer suffixes, and a neighbour's common prefix
is one more than the smallest in the interval between the two. Values below what can still reach
``length`` end an interval; those that reach it mark the window as repeated.

Pieces meet by anchor in bounded tasks. An anchor with more than ``many`` different pieces
is split by window instead, down to one group for each window, so no task holds all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import carried, dropped, joined, scratch, with_row, written
from ._text import Rolling, chunks, flat, mix

LENGTH = 400
GRAM = 64
MANY = 20_000
PIECES_PER_TASK = 12_000


def _anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Pieces of the texts: runs of windows with the same anchor occurrence."""
    sizes = np.maximum(np.diff(off) - length + 1, 0)
    total = int(sizes.sum())
    if not total:
        return {}
    rolling = Rolling(data)
    hashes = rolling.every(gram)
    low = np.uint64(0xFFFFFFFF)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    have, span = 1, length - gram + 1
    while 2 * have <= span:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < span:
        best = np.minimum(best[: len(best) - (span - have)], best[span - have :])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + off[:-1][doc]
    at = (best[start] & low).astype(np.int64)
    first = np.ones(total, bool)
    first[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], total) - 1
    s0, s1, at, doc = start[lo], start[hi], at[lo], doc[lo]
    shape = (s1 - s0).astype(np.uint64) * np.uint64(1 << 20) + (at - s0).astype(np.uint64)
    piece = mix(rolling(s0, s1 + length) ^ mix(shape + np.uint64(1)))
    return {"anchor": hashes[at].view(np.int64), "piece": piece.view(np.int64), "doc": doc, "start": s0 - off[doc], "span": s1 - s0, "at": at - s0}


_RUNS = "anchor long, piece long, id0 long, tk long, start long, span int, at int"


def _merged(spans: Iterable[dict]) -> list[list[int]]:
    """Ranges in order, those that meet as one."""
    out: list[list[int]] = []
    for x in spans:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return out


def _run_rows(length: int, gram: int):
    """Pieces of the texts, or, with a fourth column of ranges, of what these cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2)):
                inner = None
                if batch.num_columns > 3:
                    inner = [(i, a, b) for i, spans in enumerate(batch.column(3).slice(lo, hi - lo).to_pylist()) for a, b in _merged(spans) if b - a >= length]
                    data = np.concatenate([data[off[i] + a : off[i] + b] for i, a, b in inner]) if inner else data[:0]
                    off = np.cumsum([0, *(b - a for _, a, b in inner)])
                x = _anchors(data, off, length, gram)
                if x:
                    if inner:
                        x["start"] = x["start"] + np.array([a for _, a, _ in inner])[x["doc"]]
                        x["doc"] = np.array([i for i, _, _ in inner])[x["doc"]]
                    row = pa.array(x["doc"] + lo)
                    columns = [pa.array(x["anchor"]), pa.array(x["piece"]), batch.column(0).take(row), batch.column(1).take(row), pa.array(x["start"]), pa.array(x["span"].astype(np.int32)), pa.array(x["at"].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "id0", "tk", "start", "span", "at"])

    return run


_PIECES = "anchor long, id0 long, tk long, start long, span int, at int, c long, many boolean, body binary"
_PIECE_NAMES = ["anchor", "id0", "tk", "start", "span", "at", "c", "many", "body"]


def _cut_rows(length: int):
    """The bytes of the pieces that each text carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(2)):
                own = batch.column(3).slice(lo, hi - lo)
                parts = own.flatten()
                row = np.repeat(np.arange(hi - lo), np.diff(own.offsets.to_numpy()))
                get = lambda name: parts.field(name).to_numpy()  # noqa: B023, E731
                start, size = get("start") + off[row], get("span") + length
                ends = np.cumsum(size)
                take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
                body = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(data[take])]).cast(pa.binary())
                index = pa.array(row + lo)
                columns = [parts.field("anchor"), batch.column(0).take(index), batch.column(1).take(index), *(parts.field(n) for n in ("start", "span", "at", "c", "many")), body]
                yield pa.RecordBatch.from_arrays(columns, _PIECE_NAMES)

    return run


def repeated_windows(group: np.ndarray, data: np.ndarray, off: np.ndarray, at: np.ndarray, span: np.ndarray, length: int) -> np.ndarray:
    """For each piece and each of its windows, whether another piece of its group has the window too."""
    n, widest = len(group), int(span.max()) + 1
    flags = np.zeros((n, widest), bool)
    anchor = off[:-1] + at
    right = span + length - at
    reach = int(right.max())
    columns = np.arange(reach)
    rows = np.zeros((n, reach), np.uint8)
    inside = columns[None, :] < right[:, None]
    rows[inside] = data[(anchor[:, None] + columns[None, :])[inside]]
    del inside
    order = np.argsort(rows.view(f"S{reach}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    # common[i]: the common prefix of the suffixes at places i - 1 and i of the order; -1 between groups.
    common = np.full(n + 1, -1, np.int64)
    for lo in range(1, n, 4096):
        x, y = order[lo - 1 : min(n, lo + 4096) - 1], order[lo : lo + 4096]
        differ = rows[x] != rows[y]
        far = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
        common[lo : lo + len(y)] = np.where(group[x] == group[y], np.minimum(far, np.minimum(right[x], right[y])), -1)
    del rows
    for level in range(int(at.max()) + 1):
        best = np.maximum(common[:-1], common[1:])
        window = at[order] - level
        hit = (best >= length) & (window >= 0) & (window <= span[order])
        flags[order[hit], window[hit]] = True
        keep = np.flatnonzero((window > 0) & (best + window >= length))
        if len(keep) < 2:
            break
        rest = order[keep]
        key = group[rest] * 256 + data[anchor[rest] - level - 1]
        move = np.argsort(key, kind="stable")
        key, place, order = key[move], keep[move], rest[move]
        x, y = place[:-1], place[1:]
        same = key[1:] == key[:-1]
        ahead = np.full(len(order) + 1, -1, np.int64)
        ends = np.column_stack((x[same] + 1, y[same] + 1)).ravel()
        if len(ends):
            ahead[1:-1][same] = 1 + np.minimum.reduceat(common, ends)[::2]
        # A pair that was not in one interval has nothing in common beyond the new byte.
        common = ahead
    return flags


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of true flags."""
    wide = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


_SPANS = "id0 long, tk long, a long, b long"


def _extend(length: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        get = lambda name: rows.column(name).to_numpy()
        data, off = flat(rows.column("body"))
        _, group = np.unique(get("anchor"), return_inverse=True)
        at, span = get("at").astype(np.int64), get("span").astype(np.int64)
        flags = repeated_windows(group, data, off, at, span, length)
        flags[get("c") > 1] = False
        row, first, last = _runs_of(flags)
        start = get("start")[row]
        return pa.table({"id0": get("id0")[row], "tk": get("tk")[row], "a": start + first, "b": start + last + length})

    return run


def _window_rows(length: int):
    """A row for each window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in chunks(batch.column(8)):
                size = np.diff(off) - length + 1
                row = np.repeat(np.arange(hi - lo), size)
                shift = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                start = off[row] + shift
                key = Rolling(data)(start, start + length).view(np.int64)
                index = pa.array(row + lo)
                place = batch.column(3).take(index).to_numpy() + shift
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), pa.array(key), batch.column(1).take(index), batch.column(2).take(index), pa.array(place), batch.column(6).take(index)], ["anchor", "key", "id0", "tk", "a", "c"])

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, more: Sequence[Column] = ()) -> DataFrame:
    """Rows are known by id and a hash of the text, so that repeated ids with other texts stay apart."""
    doc_id = F.col(id_col).cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(2**63))).alias("id0"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"), doc_id.alias("doc_id"), *more)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY, inside: DataFrame | None = None) -> DataFrame:
    """Byte ranges ``[a, b)`` of the texts (UTF-8) that repeated strings of ``length`` bytes cover.

    Returns ``id0, tk, spans`` (an id, null as the least long, a hash of the text, and its ranges in order), one row
    for each text that has some. Ranges may overlap. Null, empty and shorter texts have none. Anchors and pieces of very many
    texts are sent to all tasks instead of being joined in one. ``inside``: the result for a shorter length, which covers
    everything that is repeated at this one, so that nothing else is searched.
    """
    with scratch(docs.sparkSession) as kept:
        keyed = _keyed(docs, id_col, text_col)
        searched = keyed.select("id0", "tk", "text")
        if inside is not None:
            searched = searched.join(inside.hint("shuffle_hash"), ["id0", "tk"]).select("id0", "tk", "text", "spans")
        runs = written(searched.mapInArrow(_run_rows(length, gram), _RUNS), "runs")
        anchors = runs.groupBy("anchor").agg(F.count("*").alias("n"), F.min("piece").alias("p0"), F.max("piece").alias("p1")).filter("n > 1")
        anchors = written(anchors.select("anchor", "n", (F.col("p0") != F.col("p1")).alias("mixed")), "anchors")
        again = written(joined(runs, anchors, ["anchor"], "n").drop("n"), "again")
        dropped(runs)
        classes = again.groupBy("anchor", "piece", "mixed").agg(F.count("*").alias("c"), F.min(F.struct("id0", "tk", "start", "span", "at")).alias("x"))
        classes = written(classes, "classes")
        whole = joined(again, classes.filter("c > 1").select("anchor", "piece", "c"), ["anchor", "piece"], "c")
        whole = whole.select("id0", "tk", F.col("start").alias("a"), F.expr(f"start + span + {length}").alias("b"))

        # Pieces that occur once, with all other pieces of their anchors.
        kinds = classes.filter("mixed").groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("c").alias("least")).filter("least = 1")
        carried = joined(classes, written(kinds, "kinds"), ["anchor"], "kinds").select("x.*", "anchor", "c", (F.col("kinds") > many).alias("many"))
        carried = carried.groupBy("id0", "tk").agg(F.collect_list(F.struct("anchor", "start", "span", "at", "c", "many")).alias("pieces"))
        cut = keyed.select("id0", "tk", "text").join(carried.hint("shuffle_hash"), ["id0", "tk"])
        pieces = written(cut.mapInArrow(_cut_rows(length), _PIECES), "pieces")
        few = pieces.filter("not many")
        tasks = few.count() // PIECES_PER_TASK + 1
        extended = few.groupBy(F.expr(f"pmod(xxhash64(anchor), {tasks})")).applyInArrow(_extend(length), _SPANS)
        windows = pieces.filter("many").mapInArrow(_window_rows(length), "anchor long, key long, id0 long, tk long, a long, c long")
        twice = written(windows.groupBy("anchor", "key").agg(F.sum("c").alias("n")).filter("n > 1"), "twice")
        single = joined(windows.filter("c = 1"), twice, ["anchor", "key"], "n").select("id0", "tk", "a", F.expr(f"a + {length}").alias("b"))
        spans = whole.unionByName(extended).unionByName(single)
        return kept(spans.groupBy("id0", "tk").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")


def _remove_rows(text: bool, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, spans in zip(batch.column(1), batch.column(2), strict=True):
                body = (body.as_py() or "").encode()
                merged = [m for m in _merged(spans.as_py() or []) if not least_words or len(body[m[0] : m[1]].split()) >= least_words]
                edges = [0, *(e for m in merged for e in m), len(body)]
                left = b"".join(body[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
                row = (len(body), len(body) - len(left), len(merged), hashlib.sha256(left).hexdigest())
                if text:
                    row += (_whole_characters(body, edges), [{"a": a, "b": b} for a, b in merged])
                out.append(row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))][: 6 if text else 4]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][: len(kinds) + 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *batch.columns[3:]], names + batch.schema.names[3:])

    return run


def _whole_characters(body: bytes, edges: list[int]) -> str:
    """What is left, with every character of which a byte is left."""
    tail = lambda i: i < len(body) and body[i] & 0xC0 == 0x80
    parts, done = [], 0
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        if i == j:
            continue
        while tail(i):
            i -= 1
        while tail(j):
            j += 1
        i = max(i, done)
        parts.append(body[i:j])
        done = max(done, j)
    return b"".join(parts).decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, many: int = MANY, texts: bool = False, carry: bool = False, least_words: int = 0) -> DataFrame:
    """Remove every byte of a text that a string of ``length`` bytes covers which starts anywhere else too.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row, and with
    ``texts`` also ``kept`` (what is left; a character cut in part stays whole) and ``spans``, with ``carry`` the whole
    row as ``row``. With ``least_words`` covered runs with fewer words, those at its ends counted as they are cut, stay. Strings are
    judged on the input, overlaps count, and equal rows are repeats of each other. Null text is empty
    and an id may be null. Extra columns are not read; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram, many)
    row = carried(docs) if carry else []
    found = _keyed(docs, id_col, text_col, row).join(spans.hint("shuffle_hash"), ["id0", "tk"], "left").select("doc_id", "text", "spans", *["row"] * carry)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.mapInArrow(_remove_rows(texts, least_words), with_row(schema + ", kept string, spans array<struct<a:long,b:long>>" * texts, found))


def _both_rows(words: int):
    remove = _remove_rows(False, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sizes = [], []
            for body, spans in zip(batch.column(1), batch.column(3), strict=True):
                body = (body.as_py() or "").encode()
                long = [m for m in _merged(spans.as_py() or []) if len(body[m[0] : m[1]].split()) >= words]
                counts.append(len(long))
                sizes.append(sum(b - a for a, b in long))
            (kept,) = remove(iter([batch.select([0, 1, 2])]))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], [*kept.schema.names, "n_passages", "passage_bytes"])

    return run


def repeats_and_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, passage: int = 240, passage_gram: int = 40, words: int = 51) -> DataFrame:
    """``remove_repeats`` at ``length`` bytes, and how much of a text is in repeated passages of ``words`` words or more.

    Adds ``n_passages, passage_bytes``: runs that repeated strings of ``passage`` bytes (at most ``length``) cover, of at least so many words. The shorter
    strings are found first; the longer ones are searched only where these are.
    """
    if passage > length:
        raise ValueError("passages must not be longer than the strings")
    wide = repeated_spans(docs, id_col, text_col, passage, passage_gram)
    spans = repeated_spans(docs, id_col, text_col, length, gram, inside=wide)
    told = wide.join(spans.withColumnRenamed("spans", "long"), ["id0", "tk"], "left")
    out = _keyed(docs, id_col, text_col).join(told.hint("shuffle_hash"), ["id0", "tk"], "left")
    return out.select("doc_id", "text", "long", "spans").mapInArrow(_both_rows(words), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")
