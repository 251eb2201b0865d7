r"""Source divergence audit: how far the terms of each source differ from those of its language and of other sources.

Chunk factorization: white-space chunks, in small letters and from their first letter to their last, are counted for each document in the tasks that read it, and leave
these already summed by language and source.
Each globally distinct chunk is split into terms once; the terms are joined back to the counts.

Whether a term is in at least ``least`` documents is decided without a row for each document: a chunk's row has its number of documents and the
smallest and largest of their row numbers. If the number reaches ``least``, so does the term; if none does, numbers are at most two,
the two row numbers are all documents there are, and distinct ones are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import joined, scratch, written
from ._text import LOWER, NOT_SPACE, chunks, table, words

LEAST_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms times sources that a task compares at a time.
CELLS = 1 << 15
#: Terms match ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LETTER = table([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_COUNTS = "lang string, source string, chunk string, n long, docs long, lo long, hi long"


def _binary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes from each start to its end as one binary array; ranges are in order and apart."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    body = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_COUNTS`` for each language, source and chunk with a letter of a bounded run of documents; one without chunk for each language and source."""
    names = [x.split()[0] for x in _COUNTS.split(", ")]
    for batch in batches:
        for lo, hi, data, off in chunks(batch.column(2), 4 << 20):
            lang, source = (batch.column(i).slice(lo, hi - lo).dictionary_encode() for i in (0, 1))
            number = batch.column(3).slice(lo, hi - lo).to_numpy()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            data = LOWER[data]
            starts, ends, before = words(data, off, NOT_SPACE)
            at = np.flatnonzero(_LETTER[data])
            first, behind = np.searchsorted(at, starts), np.searchsorted(at, ends)
            has = behind > first
            doc = np.repeat(np.arange(hi - lo), np.diff(before))[has]
            # What is before the first letter of a chunk and behind the last is in no term.
            chunk = _binary(data, at[first[has]], at[behind[has] - 1] + 1).dictionary_encode()
            m = max(1, len(chunk.dictionary))
            # Counts of each document, then of each language and source; documents stay in order.
            own, n = np.unique(doc * m + chunk.indices.to_numpy(), return_counts=True)
            doc, key = own // m, group[own // m] * m + own % m
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            docs = np.diff(np.append(first, len(order)))
            every = np.unique(group)
            all_, key, blank = np.concatenate((every, key[order][first] // m)), key[order][first] % m, len(every)
            sums = np.add.reduceat(n[order], first) if len(first) else first
            pad = lambda x: pa.concat_arrays([pa.array(np.zeros(blank, np.int64)), pa.array(x.astype(np.int64))])  # noqa: B023, E731
            row = lambda at: pa.concat_arrays([pa.nulls(blank, pa.int64()), pa.array(number[doc[order][at]])])  # noqa: B023, E731
            chunk_ = pa.concat_arrays([pa.nulls(blank, pa.large_string()), chunk.dictionary.take(pa.array(key)).cast(pa.large_string())])
            lang_, source_ = lang.dictionary.take(pa.array(all_ // len(source.dictionary))), source.dictionary.take(pa.array(all_ % len(source.dictionary)))
            columns = [lang_, source_, chunk_.cast(pa.string()), pad(sums), pad(docs), row(first), row(first + docs - 1)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of any size."""
    wide = lambda c: c.cast("decimal(20,0)")
    parts = F.struct((F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 1)).alias("up"), (wide(total) + wide(terms)).alias("down"))
    return 1 + F.call_function("div", parts.up, parts.down)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_rows(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms of one bucket, for each source of a language against each other one."""
    names = sources.column("source").combine_chunks()
    at = pc.index_in(terms.column("source"), names).to_numpy()
    code = terms.column("term").combine_chunks().dictionary_encode()
    p = np.tile(sources.column("p0").to_numpy(), (len(code.dictionary), 1))
    p[code.indices.to_numpy(), at] = terms.column("p").to_numpy()
    n = len(names)
    lang, one, two, value = [], [], [], []
    for i in range(n):
        d = p[:, i : i + 1] - p
        sums = (d * d // p).sum(axis=0, dtype=np.int64)
        others = np.delete(np.arange(n), i)
        one.append(np.full(n - 1, i))
        two.append(others)
        value.append(sums[others])
    one, two, value = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (one, two, value))
    lang = pa.array([key[0].as_py()] * len(one), pa.string())
    return pa.table({"lang": lang, "source": names.take(pa.array(one)), "item": names.take(pa.array(two)), "value": value})


def _ranked(rows: DataFrame, part: str, value: Column, top: int | None = None) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = rows.withColumn("value", value).withColumn("rank", F.row_number().over(order))
    out = out.filter(F.col("rank") <= top) if top else out
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    r"""Divergence of the term frequencies of each (language, source) group.

    Terms are matches of ``TERM``, only A-Z lower-cased; a language keeps the V terms that at least ``least`` (1 to 3) of its documents hold. A group, or
    a language, gives each kept term p = 1 + floor(10^9 * (count + 1) / (N + V)), with N the sum of its counts of kept terms. Against q, p gives
    floor((p - q)^2 / q). Returns ``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language and the sum over
    kept terms (0 without any), part ``term`` the ``top`` kept terms of the group with p over the language's. Ranks
    go by value, largest first, then by the item's bytes. All arithmetic is on integers. A value fits a long as long as a language keeps at most 10^9 terms.

    Null text, language or source is ``''``. Every row is a document of its own, also if ids or rows are repeated; ids and other columns are
    not read. Groups without terms are part of it; a language of one source has no pairs. An empty table gives an empty result.
    """
    if not 1 <= least <= 3:
        raise ValueError("least is 1, 2 or 3")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"), F.monotonically_increasing_id().alias("number"))
    with scratch(docs.sparkSession) as kept:
        counted = docs.mapInArrow(_count_rows, _COUNTS).groupBy("lang", "source", "chunk")
        # Where the number of documents decides, their row numbers are not needed.
        few = lambda c: F.when(F.sum("docs") < least, c)
        counts = written(counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), few(F.min("lo")).alias("lo"), few(F.max("hi")).alias("hi")), "chunks")
        real = counts.filter(F.col("chunk").isNotNull())
        distinct = real.groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"))
        split = written(distinct.select("chunk", "rows", F.regexp_extract_all(F.col("chunk"), F.lit(TERM), F.lit(0)).alias("terms")), "terms")
        each = joined(real, split, ["chunk"], "rows").select("lang", "source", F.explode("terms").alias("term"), "n", "docs", "lo", "hi")
        each = written(each, "each")

        seen = F.when(F.col("lo").isNull() | (F.col("lo") == F.col("hi")), F.array("lo")).otherwise(F.array("lo", "hi"))
        held = each.select("lang", "term", "docs", F.explode(seen).alias("row")).groupBy("lang", "term")
        often = held.agg(F.max("docs").alias("docs"), F.count_distinct("row").alias("rows")).filter(F.greatest("docs", "rows") >= least).select("lang", "term")
        by_source = each.groupBy("lang", "source", "term").agg(F.sum("n").alias("c"))
        terms = written(by_source.join(often, ["lang", "term"]).withColumn("all", F.sum("c").over(W.partitionBy("lang", "term"))), "counts")

        langs = terms.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_n"), F.count(F.lit(1)).alias("v"))
        own = terms.groupBy("lang", "source").agg(F.sum("c").alias("own_n"), F.count(F.lit(1)).alias("rows"))
        groups = counts.filter(F.col("chunk").isNull()).select("lang", "source")
        sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        groups = groups.join(sizes, "lang").join(own, ["lang", "source"], "left")
        groups = written(groups.select("lang", "source", "sources", *map(zero, ("lang_n", "v", "own_n", "rows"))), "groups")

        placed = joined(terms, groups.filter("rows > 0"), ["lang", "source"], "rows")
        buckets = F.floor(F.col("v") * F.col("sources") / CELLS).cast("int") + 1
        bucket = F.pmod(F.xxhash64("term"), buckets).cast("int").alias("bucket")
        placed = placed.select("lang", "source", "term", bucket, _p(F.col("c"), F.col("own_n"), F.col("v")).alias("p"), _p(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))
        p0 = F.when(F.col("v") == 0, F.lit(1).cast("long")).otherwise(_p(F.lit(0), F.col("own_n"), F.greatest("v", F.lit(1)))).alias("p0")
        spine = groups.select("lang", "source", p0, F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"))
        sums = placed.select("lang", "bucket", "source", "term", "p").groupBy("lang", "bucket").cogroup(spine.groupBy("lang", "bucket"))
        pairs = sums.applyInArrow(_pair_rows, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        pairs = _ranked(pairs, "pair", F.col("value"))
        over = placed.filter("p > q").withColumnRenamed("term", "item")
        return kept(pairs.unionByName(_ranked(over, "term", _apart(F.col("p"), F.col("q")), top)), "audit")
