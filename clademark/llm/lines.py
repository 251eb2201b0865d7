r"""Line dedup: lines that many documents hold stay in one of them.

Normalised lines are hashed, documents are counted for each hash, and what is over the threshold is dropped by position.
Texts are shuffled once, and only those with a line long enough to count; all else works on hashes. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import joined, scratch, written

LEAST_CHARS, LEAST_DOCS = 40, 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ``[\x20\x09-\x0D]``
_WHITE = " \t\n\x0b\x0c\r"


def _trimmed(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(_WHITE)))


def lower_ascii(x: Column) -> Column:
    """A-Z alone to a-z; texts of single bytes by the faster function, which does the same for them."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _UPPER.lower()))


def _two(*values: Column) -> list[Column]:
    """128 bits of hash."""
    return [F.xxhash64(F.lit(seed), *values) for seed in (31, 32)]


def _marks(text: Column, least_chars: int) -> Column:
    """``h1, h2, pos`` of the lines that are long enough, ordered."""
    keys = F.transform(_trimmed(text), lambda x: F.when(F.char_length(x) >= least_chars, lower_ascii(x)))
    hashed = F.transform(keys, lambda x, i: F.when(x.isNotNull(), F.struct(*(h.alias(n) for h, n in zip(_two(x), ("h1", "h2"), strict=True)), i.alias("pos"))))
    return F.sort_array(F.filter(hashed, lambda m: m.isNotNull()))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    r"""Documents without the lines that at least ``least_docs`` of them hold, but for those of the largest id.

    Texts are split at ``\n``. A line's key is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z lower-cased; keys under ``least_chars``
    code points never count. Returns ``doc_id, n_lines`` (before), ``n_dropped, kept`` (the other lines, joined by ``\n``).

    Null and empty texts are one empty line. Every row is a document of its own, also where ids or whole rows are repeated; rows that share
    the largest id all keep the line. A row without id comes before all ids, so that a line which only such rows hold stays in all of
    them. Keys are told apart by 128 bits of hash, rows by 128 bits of id and text: equal rows have equal results. Other columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    row = [h.alias(n) for h, n in zip(_two(F.col("doc_id"), F.col("text")), ("r1", "r2"), strict=True)]
    with scratch(docs.sparkSession) as kept:
        lines = written(docs.select("doc_id", *row, _marks(F.col("text"), least_chars).alias("marks")).filter(F.size("marks") > 0), "lines")
        # Marks are ordered, so that the first of a key is the one that differs from the mark before it.
        before = F.concat(F.array(F.lit(None).cast(lines.schema["marks"].dataType.elementType)), F.slice("marks", 1, F.size("marks") - 1))
        first = lambda m, b: F.struct(m.h1.alias("h1"), m.h2.alias("h2"), F.when(b.isNull() | (b.h1 != m.h1) | (b.h2 != m.h2), 1).otherwise(0).alias("new"))
        each = lines.select("doc_id", F.inline(F.zip_with("marks", before, first)))
        counts = each.groupBy("h1", "h2").agg(F.sum("new").alias("docs"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
        often = written(counts.filter(F.col("docs") >= least_docs).select("h1", "h2", "last", "rows"), "often")
        found = joined(lines.select("doc_id", "r1", "r2", F.inline("marks")), often, ["h1", "h2"], "rows").filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        drops = kept(found.groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone")), "drops")
    has = F.exists(_trimmed(F.col("text")), lambda x: F.char_length(x) >= least_chars)
    split = docs.withColumn("lines", F.split("text", "\n", -1))
    cut = split.filter(has).select("doc_id", "lines", *row).join(drops, ["r1", "r2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    cut = cut.select("doc_id", F.size("lines").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"), F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("kept"))
    whole = split.filter(~has).select("doc_id", F.size("lines").alias("n_lines"), F.lit(0).alias("n_dropped"), F.col("text").alias("kept"))
    return cut.unionByName(whole).select("doc_id", F.col("n_lines").cast("long"), F.col("n_dropped").cast("long"), "kept")
