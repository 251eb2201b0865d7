"""Scans of variant calls, sequences, alignments, reads and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.ranks import numbered


def read_vcf(spark: SparkSession, paths) -> DataFrame:
    """A row for each record and usable ALT (S-1): 0-based position, upper case, U as T.

    Frequency: the first of INFO AF, VAF, FREQ and FORMAT AF, AD / sum of AD by ALT; what is missing shares the rest
    equally. Depth: INFO DP, DEPTH, FORMAT DP, sum of AD, else -1. ``run_id`` is the file.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    x = lines.select(
        S.safe_stem(F.col("path")).alias("run_id"), F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("int") - 1).alias("pos"), F.get(f, F.lit(3)).alias("ref"),
        F.split(F.get(f, F.lit(4)), ",").alias("alts"), F.get(f, F.lit(6)).alias("filter"), F.str_to_map(F.get(f, F.lit(7)), F.lit(";"), F.lit("=")).alias("info"),
        F.map_from_arrays(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":"), F.slice(F.concat(F.split(F.coalesce(F.get(f, F.lit(9)), F.lit("")), ":"), F.array_repeat(F.lit(None).cast("string"), F.size(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":")))), F.lit(1), F.size(F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":")))).alias("fmt"),
    )
    numbers = lambda source, name: F.transform(F.split(F.try_element_at(source, F.lit(name)), ","), S.number_or_percent)
    ad = numbers(F.col("fmt"), "AD")
    total = F.aggregate(ad, F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0)))
    x = x.withColumns({"depth": F.coalesce(*[F.get(numbers(F.col(s), n), F.lit(0)).cast("int") for s, n in (("info", "DP"), ("info", "DEPTH"), ("fmt", "DP"))], total.cast("int"), F.lit(-1)), "ad": ad, "total": total})
    lists = [numbers(F.col(s), n) for s, n in (("info", "AF"), ("info", "VAF"), ("info", "FREQ"), ("fmt", "AF"))]
    each = F.transform("alts", lambda a, i: F.coalesce(*[F.get(v, i) for v in lists], F.try_divide(F.get(F.col("ad"), i + 1), F.col("total"))))
    x = x.withColumn("afs", each)
    known = F.aggregate("afs", F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0)))
    rest = F.try_divide(F.greatest(F.lit(0.0), 1 - known), F.size(F.filter("afs", lambda v: v.isNull())))
    x = x.withColumn("rest", rest).select("run_id", "chrom", "pos", "ref", "filter", "depth", "afs", "rest", F.posexplode("alts").alias("i", "alt"))
    clean = lambda c: F.translate(F.upper(c), "U", "T")
    return x.filter(S.is_nucleotide_alt(F.col("alt"))).select("run_id", "chrom", "pos", clean("ref").alias("ref"), clean("alt").alias("alt"), "filter", F.coalesce(F.get("afs", F.col("i")), "rest").alias("af"), "depth")


def vcf_contigs(calls: DataFrame) -> DataFrame:
    """Contigs that data rows name (S-2)."""
    return calls.select("run_id", "chrom").distinct()


def read_fasta(spark: SparkSession, paths) -> DataFrame:
    """Records with the id from the header's first word; upper case, U as T, N at the end removed (S-3). Of an id that comes again the last record of the last file stays."""
    x = spark.read.option("lineSep", ">").text(paths).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")).filter(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    x = x.select(F.split(F.trim(head), r"\s+")[0].alias("id"), F.regexp_replace(F.translate(seq, "U", "T"), "N+$", "").alias("sequence"), "at")
    return x.groupBy("id").agg(F.max_by("sequence", "at").alias("sequence"))


def read_alignments(spark: SparkSession, paths) -> DataFrame:
    """PAF rows with a ``cg:Z:`` tag, the first primary one for each query and feature (S-8)."""
    x = spark.read.text(paths).withColumn("at", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    names = ["query", "query_length", "query_start", "query_end", "strand", "feature", "feature_length", "feature_start", "feature_end", "matches", "block"]
    kinds = {n: "string" for n in ("query", "strand", "feature")}
    x = x.filter(~F.col("value").rlike(r"\ttp:A:[Ss](\t|$)")).select("value", "at", *[F.get(f, F.lit(i)).try_cast(kinds.get(n, "int")).alias(n) for i, n in enumerate(names)])
    x = x.select("at", *names, F.try_divide("matches", "block").alias("identity"), F.regexp_extract("value", r"\tcg:Z:([0-9MIDNSHP=X]+)", 1).alias("cigar"))
    first = x.groupBy("query", "feature").agg(F.min(F.struct("at", *[c for c in x.columns if c not in ("at", "query", "feature")])).alias("r"))
    return first.select("query", "feature", "r.*").drop("at").select(*names, "identity", "cigar")


def read_sam(spark: SparkSession, paths) -> DataFrame:
    """Aligned reads from SAM text, positions from 0 (S-9)."""
    x = spark.read.text(paths).filter(~F.col("value").startswith("@") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    get = lambda i: F.get(f, F.lit(i))
    return x.select(get(0).alias("qname"), get(1).cast("int").alias("flag"), get(2).alias("chrom"), (get(3).cast("int") - 1).alias("pos"), get(4).cast("int").alias("mapq"), get(5).alias("cigar"), get(9).alias("seq"), get(10).alias("qual"))


def read_tsv(spark: SparkSession, path, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """A table of texts with a header; blanks are null; alias columns are put together (S-5, S-6)."""
    x = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    filled = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in x.columns}
    x = x.select(*[v.alias(c) for c, v in filled.items()])
    for name, others in (aliases or {}).items():
        have = [c for c in [name, *others] if c in x.columns]
        x = x.withColumn(name, F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None).cast("string")).drop(*[c for c in have if c != name])
    return x


def read_numbered_tsv(spark: SparkSession, path: str, aliases: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows as ``read_tsv`` gives them with ``file`` and ``row_no``, the columns as written) of one file; the header is row 1."""
    x = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    written = [c.strip() for c in x.columns]
    plain = x.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip()) for c in x.columns], F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    for name, others in (aliases or {}).items():
        have = [c for c in [name, *others] if c in plain.columns]
        if have:
            plain = plain.withColumn(name, F.coalesce(*map(F.col, have))).drop(*[c for c in have if c != name])
    return numbered(plain, ["_block", "_id"], "row_no", start=2).drop("_block", "_id").withColumn("file", F.lit(path)), written


def write_clean_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text; tabs and line breaks in values become blanks (S-15)."""
    clean = [F.regexp_replace(F.col(c), r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(clean).write.csv(path, sep="\t", header=True)
