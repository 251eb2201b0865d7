"""Reference genomes from GenBank flat files: records, their coding features and where these lie (S-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alleles import let

# The column at which locations and qualifiers of the feature table begin, and that of its keys.
_INDENT, _KEY_INDENT = 21, 5
_PART = "struct<start:int,end:int,strand:int>"


def _field(text: Column, key: str) -> Column:
    """What a header line says, without the lines that continue it; empty without one."""
    return F.trim(F.regexp_extract(text, rf"(?m)^ *{key} +(\S[^\r\n]*)", 1))


def _lineage(text: Column) -> Column:
    """The lines below that of the organism, as one list without its final stop."""
    lines = F.regexp_extract(text, r"(?m)^ *ORGANISM[^\n]*((?:\n {12}[^\n]*)*)", 1)
    items = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(lines, r"\s+", " "), r"\.\s*$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(items, "; ")


def location_parts(location: Column) -> Column:
    """The parts of a location without blanks, in coding order: 0-based ``start``, ``end`` after the last, ``strand``.

    Known are spans and single bases, ``complement``, ``join`` and ``order``, bounds beyond the record (``<``, ``>``) and references to it by name; a complement of several parts turns their order. A location
    that says something else has no parts.
    """
    outer = location.rlike(r"^complement\((join|order)\(")
    inner = F.regexp_replace(location, r"^(complement\()?(join|order)\(|\)+$", "")
    inner = F.when(location.rlike(r"^(complement\()?(join|order)\("), inner).otherwise(location)

    def part(x: Column) -> Column:
        at = F.regexp_replace(x, r"[\w.]+:|[<>]", "")
        a, b = (F.regexp_extract(at, r"^(?:complement\()?(\d+)(?:(?:\.\.|\^|\.)(\d+))?\)?$", i) for i in (1, 2))
        end = F.when(b == "", a).otherwise(b)
        return F.struct((a.try_cast("int") - 1).alias("start"), end.try_cast("int").alias("end"), F.when(outer | x.startswith("complement"), -1).otherwise(1).alias("strand"))

    parts = F.transform(F.split(inner, ","), part)
    parts = F.when(outer, F.reverse(parts)).otherwise(parts)
    return F.when(F.exists(parts, lambda p: p.start.isNull() | p.end.isNull()), F.array().cast(f"array<{_PART}>")).otherwise(parts)


def _qualifiers(text: Column) -> Column:
    """``key, value`` of all qualifiers of a feature, quotes undone and lines put together."""
    found = F.regexp_extract_all(text, F.lit(rf'(?m)^ {{{_INDENT}}}/[\w-]+(?:="[^"]*(?:""[^"]*)*"|=[^\n]*)?'), F.lit(0))

    def one(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(x, r"^ +/[\w-]+=?", ""), r'^"|"\s*$', "")
        return F.struct(F.regexp_extract(x, r"^ +/([\w-]+)", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_replace(value, r"\s*\n\s*", " "), '""', '"')).alias("value"))

    return F.transform(found, one)


def _first(qualifiers: Column, *keys: str) -> Column:
    """The first value of each key in turn that is not blank."""
    def of(key: str) -> Column:
        known = F.filter(qualifiers, lambda q: (q.key == key) & (q.value != ""))
        return F.get(F.transform(known, lambda q: q.value), F.lit(0))

    values = map(of, keys)
    return F.coalesce(*values, F.lit(""))


def _sequence(parts: Column, genome: Column) -> Column:
    piece = lambda p: let(F.substring(genome, p.start + 1, p.end - p.start), lambda s: F.when(p.strand == -1, S.reverse_complement(s)).otherwise(s))
    return F.translate(F.array_join(F.transform(parts, piece), ""), "U", "T")


def _tables(text: Column, genome: Column) -> Column:
    """The coding features of a record: number, kind, parts, qualifiers and sequence."""
    block = F.regexp_extract(text, r"(?s)\nFEATURES[^\n]*(\n.*?)(?:\n[A-Z]|\z)", 1)
    rows = F.filter(F.transform(F.split(block, rf"\n(?= {{{_KEY_INDENT}}}\S)"), lambda x, i: F.struct(x.alias("text"), i.alias("number"))), lambda x: x.text.rlike(r"^ {5}(CDS|mat_peptide) "))

    def one(x: Column) -> Column:
        location = F.regexp_replace(F.regexp_extract(x.text, rf"(?s)^ +\S+ +(.*?)(?:\n {{{_INDENT}}}/|\z)", 1), r"\s", "")
        return let(location_parts(location), lambda p: F.struct(x.number.alias("number"), F.regexp_extract(x.text, r"^ +(\S+)", 1).alias("kind"), p.alias("parts"), _qualifiers(x.text).alias("q"), _sequence(p, genome).alias("nt_sequence")))

    return F.transform(rows, one)


def _unique(taken: Column, names: Column) -> Column:
    """Names, one after the other, with ``_2``, ``_3`` and so on where they are taken."""

    def step(seen: Column, name: Column) -> Column:
        other = F.filter(F.transform(F.sequence(F.lit(2), F.size(seen) + 2), lambda i: F.concat(name, F.lit("_"), i.cast("string"))), lambda c: ~F.array_contains(seen, c))
        return F.concat(seen, F.array(F.when(F.array_contains(seen, name), F.get(other, F.lit(0))).otherwise(name)))

    return F.slice(F.aggregate(names, taken, step), F.size(taken) + 1, F.greatest(F.size(names), F.lit(1)))


def read_genbank(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(references, features, segments, problems) of GenBank files with any number of records (S-4).

    references: ``reference_name`` (accession with version, else accession, else locus), ``accession, length, organism, taxonomy, sequence``. features: one row for each CDS and mature peptide, in the order of
    the file: ``reference_name, feature_no, name, feature_type, protein, protein_id, locus_tag, note, start, end, strand, codon_start, nt_sequence, aa_sequence, parent_name``. segments: ``reference_name, name,
    segment_index, start, end`` in the order of the parts. Positions are from 0, sequences in coding orientation.

    A CDS is named by gene, locus tag, protein id, product or protein; of equal names in a record the first stays. A mature peptide is named by gene, protein id or product, else by its parent and number, with ``_2`` and so on where
    the name is taken; its parent is the first CDS of its strand around it. A given translation counts before the sequence's; a stop at its end goes. problems: ``reference_name, name, reason`` for what makes the files
    unfit: a record without id or sequence, ids or accessions that come again, a CDS without name, a location that is not understood, a stop inside.
    """
    raw = spark.read.option("lineSep", "\n//").text(paths).filter(F.col("value").rlike(r"(?m)^ *(LOCUS|FEATURES|ORIGIN|ACCESSION)"))
    text = F.concat(F.lit("\n"), F.regexp_replace("value", "\r", ""))
    x = raw.select(F.monotonically_increasing_id().alias("record"), text.alias("text"))
    first = lambda c: F.regexp_extract(c, r"^(\S+)", 1)
    accession, version, locus = first(_field(F.col("text"), "ACCESSION")), first(_field(F.col("text"), "VERSION")), first(_field(F.col("text"), "LOCUS"))
    given = lambda *c: F.coalesce(*[F.nullif(y, F.lit("")) for y in c], F.lit(""))
    genome = F.upper(F.regexp_replace(F.regexp_extract("text", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[^A-Za-z*-]", ""))
    source = F.regexp_extract("text", r'\n {21}/organism="([^"]*)"', 1)
    x = x.select("record", "text", given(version, accession, locus).alias("reference_name"), given(accession, version, locus).alias("accession"), genome.alias("sequence"), given(_field(F.col("text"), "ORGANISM"), F.trim(F.regexp_replace(source, r"\s+", " "))).alias("organism"), _lineage(F.col("text")).alias("taxonomy"))
    references = x.select("record", "reference_name", "accession", F.length("sequence").alias("length"), "organism", "taxonomy", "sequence")

    f = x.select("record", "reference_name", F.inline(_tables(F.col("text"), F.col("sequence"))))
    q, parts = F.col("q"), F.col("parts")
    aa = F.upper(F.regexp_replace(F.coalesce(F.nullif(_first(q, "translation"), F.lit("")), S.translate_seq(F.substring("nt_sequence", F.col("codon_start") + 1, F.length("nt_sequence")))), r"\s", ""))
    f = f.withColumns({"codon_start": F.coalesce(_first(q, "codon_start").try_cast("int"), F.lit(1)) - 1, "start": F.array_min(F.transform(parts, lambda p: p.start)), "end": F.array_max(F.transform(parts, lambda p: p.end)), "strand": F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.strand == -1), "-").otherwise("+")})
    f = f.withColumn("aa_sequence", aa).withColumn("stop_inside", F.regexp_replace("aa_sequence", r"\*$", "").contains("*")).withColumn("aa_sequence", F.regexp_replace("aa_sequence", r"\*$", ""))
    cds = f.filter("kind = 'CDS'").withColumn("name", _first(q, "gene", "locus_tag", "protein_id", "product", "protein"))
    cds = cds.withColumn("again", F.row_number().over(W.partitionBy("record", "name").orderBy("number")) > 1).filter(~F.col("again") | (F.col("name") == "")).drop("again").withColumn("parent_name", F.lit(""))

    # Peptides: the first CDS around each, then names in the order of the file.
    own = cds.select("record", F.col("strand"), F.col("start").alias("c0"), F.col("end").alias("c1"), F.struct("number", "name").alias("c"))
    pep = f.filter("kind = 'mat_peptide'").withColumn("index", F.row_number().over(W.partitionBy("record").orderBy("number")))
    around = pep.join(own, ["record", "strand"]).filter("start >= c0 and end <= c1").groupBy("record", "number").agg(F.min("c").alias("c"))
    pep = pep.join(around, ["record", "number"], "left").withColumn("parent_name", F.coalesce("c.name", F.lit("")))
    numbered = F.concat(F.when(F.col("parent_name") != "", F.concat("parent_name", F.lit("_"))).otherwise(""), F.lit("mat_peptide_"), F.col("index").cast("string"))
    pep = pep.withColumn("base", F.coalesce(F.nullif(_first(q, "gene", "protein_id", "product"), F.lit("")), numbered))
    # One row for each record: its names.
    taken = cds.groupBy("record").agg(F.collect_list("name").alias("taken"))
    names = pep.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("index", "base"))).alias("wanted")).join(taken, "record", "left")
    names = names.select("record", F.posexplode(_unique(F.coalesce("taken", F.array().cast("array<string>")), F.transform("wanted", lambda w: w.base))).alias("at", "name"))
    pep = pep.join(names.withColumn("index", F.col("at") + 1).drop("at"), ["record", "index"])
    columns = ["record", "reference_name", "number", "name", "kind", "q", "parts", "start", "end", "strand", "codon_start", "nt_sequence", "aa_sequence", "parent_name", "stop_inside"]
    every = cds.select(*columns).unionByName(pep.select(*columns))
    product = F.coalesce(F.nullif(_first(q, "product", "protein"), F.lit("")), F.col("name"))
    features = every.select("reference_name", F.col("number").alias("feature_no"), "name", F.col("kind").alias("feature_type"), product.alias("protein"), _first(q, "protein_id").alias("protein_id"), _first(q, "locus_tag").alias("locus_tag"), _first(q, "note").alias("note"), "start", "end", "strand", "codon_start", "nt_sequence", "aa_sequence", "parent_name")
    segments = every.select("reference_name", "name", F.posexplode("parts").alias("segment_index", "p")).select("reference_name", "name", "segment_index", "p.start", "p.end")

    wrong = lambda df, name, *cases: df.select("reference_name", name.alias("name"), F.explode(F.array_compact(F.array(*[F.when(c, r) for r, c in cases]))).alias("reason"))
    none = F.lit("")
    problems = wrong(references, none, ("no id", F.col("reference_name") == ""), ("no sequence", F.col("length") == 0))
    problems = problems.unionByName(wrong(every, F.col("name"), ("no name", F.col("name") == ""), ("unknown location", F.size("parts") == 0), ("stop inside", F.col("stop_inside"))))
    for c, reason in (("reference_name", "id comes again"), ("accession", "accession comes again")):
        again = references.groupBy(c).agg(F.count("*").alias("n"), F.min("reference_name").alias("of")).filter("n > 1")
        problems = problems.unionByName(again.select(F.col("of").alias("reference_name"), none.alias("name"), F.lit(reason).alias("reason")))
    return references.drop("record"), features, segments, problems
