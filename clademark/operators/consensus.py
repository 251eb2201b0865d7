"""Variants of consensus sequences from their alignments with coding sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.alleles import let
from .coverage import merge_codon_gaps
from .liftover import cds_to_genomic, cigar_ops

_OPS = "array<struct<n:int,op:string>>"


def junctions(segments: Column, strand: Column) -> Column:
    """Coding positions at which the second and later exons begin."""
    sizes = F.transform(F.when(strand == "-", F.reverse(segments)).otherwise(segments), lambda x: (x["end"] - x["start"]).cast("long"))
    sums = F.aggregate(sizes, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    return F.slice(sums, F.lit(1), F.greatest(F.size(sums) - 1, F.lit(0)))


def merge_ops(ops: Column) -> Column:
    """Neighbouring operations of one kind as one."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    join = lambda a, o: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct((last(a)["n"] + o["n"]).alias("n"), o["op"].alias("op"))))
    return F.aggregate(ops, F.array().cast(_OPS), lambda a, o: F.when((F.size(a) > 0) & (last(a)["op"] == o["op"]), join(a, o)).otherwise(F.concat(a, F.array(o))))


def classify_introns(cigar: Column, at: Column, tolerance: int = 5) -> Column:
    """Introns of a spliced feature in an alignment with unspliced sequence (F-14b): ``ops, introns``.

    An insertion of more than ``tolerance`` bases within ``tolerance`` of an exon junction (``at``, coding positions from the alignment's start) is an
    intron; the rest are ``ops``, merged. ``introns``: ``junction`` (coding position), ``start`` (place among the bases that the other operations read), ``length``.
    """

    def step(s: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        intron = (op == "I") & (n > tolerance) & F.exists(at, lambda j: F.abs(s["cds"] - j) <= tolerance)
        found = F.struct(s["cds"].alias("junction"), s["read"].alias("start"), n.alias("length"))
        return F.struct(
            (s["cds"] + F.when(op.isin("M", "D", "=", "X"), n).otherwise(0)).alias("cds"),
            (s["read"] + F.when(op.isin("M", "I", "=", "X") & ~intron, n).otherwise(0)).alias("read"),
            F.when(intron, s["ops"]).otherwise(F.concat(s["ops"], F.array(o))).alias("ops"),
            F.when(intron, F.concat(s["introns"], F.array(found))).otherwise(s["introns"]).alias("introns"),
        )

    zero = F.struct(F.lit(0).alias("cds"), F.lit(0).alias("read"), F.array().cast(_OPS).alias("ops"), F.array().cast("array<struct<junction:int,start:int,length:int>>").alias("introns"))
    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: F.struct(merge_ops(s["ops"]).alias("ops"), s["introns"].alias("introns")))


def exon_metrics(matches: Column, block: Column, ops: Column, introns: Column, exon_length: Column) -> Column:
    """``identity, cds_coverage`` over exons (F-14c): matches by aligned exon bases if there are introns, else by the block's length; coverage is at most 1."""
    span = F.aggregate(F.filter(ops, lambda o: o["op"].isin("M", "D")), F.lit(0), lambda a, o: a + o["n"])
    identity = F.when(F.size(introns) > 0, F.try_divide(matches, span)).otherwise(F.try_divide(matches, block))
    coverage = F.least(F.coalesce(F.try_divide(span, exon_length), F.lit(0.0)), F.lit(1.0))
    return F.struct(F.coalesce(identity, F.lit(0.0)).alias("identity"), coverage.alias("cds_coverage"))


def coding_region(query: Column, start: Column, end: Column, strand: Column, introns: Column) -> Column:
    """The aligned part of a query in coding orientation without its introns (C-3)."""
    part = F.upper(F.substring(query, start + 1, end - start))
    part = F.when(strand == "-", S.reverse_complement(part)).otherwise(part)
    # ``start`` counts bases that stay, so introns go one after the other.
    return F.aggregate(introns, part, lambda t, i: F.concat(F.substring(t, F.lit(1), i["start"]), F.substring(t, i["start"] + i["length"] + 1, F.length(t))))


def aligned_columns(cds: Column, region: Column, ops: Column, cds_start: Column) -> Column:
    """An alignment as texts (C-4): ``ref, query_text`` with gaps, and ``bases``, the query's letter at each coding position.

    Coding positions outside the alignment are gaps of the query. ``insertions`` are ``at`` (the coding position behind) and ``text``.
    """

    def step(s: Column, o: Column) -> Column:
        n, op = o["n"], o["op"]
        r, q = F.substring(cds, s["t"] + 1, n), F.substring(region, s["q"] + 1, n)
        gap = F.repeat(F.lit("-"), n)
        reads, moves = op.isin("M", "I"), op.isin("M", "D")
        ins = F.struct(s["t"].alias("at"), q.alias("text"))
        return F.struct(
            (s["q"] + F.when(reads, n).otherwise(0)).alias("q"), (s["t"] + F.when(moves, n).otherwise(0)).alias("t"),
            F.concat(s["ref"], F.when(op == "I", gap).when(moves, r).otherwise("")).alias("ref"),
            F.concat(s["query"], F.when(op == "D", gap).when(reads, q).otherwise("")).alias("query"),
            F.concat(s["bases"], F.when(op == "D", gap).when(op == "M", q).otherwise("")).alias("bases"),
            F.when(op == "I", F.concat(s["insertions"], F.array(ins))).otherwise(s["insertions"]).alias("insertions"),
        )

    lead = F.repeat(F.lit("-"), cds_start)
    zero = F.struct(F.lit(0).alias("q"), cds_start.cast("int").alias("t"), F.substring(cds, F.lit(1), cds_start).alias("ref"), lead.alias("query"), lead.alias("bases"), F.array().cast("array<struct<at:int,text:string>>").alias("insertions"))

    def finish(s: Column) -> Column:
        rest = F.greatest(F.length(cds) - s["t"], F.lit(0))
        tail = F.repeat(F.lit("-"), rest)
        return F.struct(F.concat(s["ref"], F.substring(cds, s["t"] + 1, rest)).alias("ref"), F.concat(s["query"], tail).alias("query_text"), F.concat(s["bases"], tail).alias("bases"), s["insertions"].alias("insertions"), s["t"].alias("cds_end"))

    return F.aggregate(ops, zero, step, finish)


def aligned(matches: DataFrame, queries: DataFrame, features: DataFrame, tolerance: int = 5) -> DataFrame:
    """Matches with their aligned texts, introns taken out.

    ``matches``: ``run_id, query, feature_id, strand, query_start, query_end, cds_start, cigar`` (in coding orientation); ``queries``: ``run_id, query, sequence``;
    ``features``: ``feature_id, strand, codon_start, nt_sequence, segments``. Features without sequence are left out.
    """
    f = features.filter(F.coalesce(F.length("nt_sequence"), F.lit(0)) > 0).select("feature_id", F.col("strand").alias("feature_strand"), "codon_start", F.upper("nt_sequence").alias("cds"), "segments")
    x = matches.join(queries.hint("shuffle_hash"), ["run_id", "query"]).join(f.hint("shuffle_hash"), "feature_id")
    at = F.transform(junctions(F.col("segments"), F.col("feature_strand")), lambda j: j - F.col("cds_start"))
    x = x.withColumn("_c", classify_introns(F.col("cigar"), at, tolerance)).withColumns({"ops": F.col("_c.ops"), "introns": F.col("_c.introns")})
    x = x.withColumn("region", coding_region(F.col("sequence"), F.col("query_start"), F.col("query_end"), F.col("strand"), F.col("introns"))).drop("sequence", "_c")
    # Bound outside of the steps, the region is cut once and not at each of them; as a generated row, the texts are made once for all their columns.
    texts = let(F.col("region"), lambda r: aligned_columns(F.col("cds"), r, F.col("ops"), F.col("cds_start")))
    return x.select("*", F.inline(F.array(texts))).drop("region")


def alignment_runs(matches: DataFrame) -> DataFrame:
    """Insertions and deletions of alignments, one row for each run (W-3): the matches' keys with ``op, cds_pos, n``. ``matches`` as ``aligned`` gives them."""

    def step(s: Column, o: Column) -> Column:
        run = F.struct(o["op"].alias("op"), s["t"].alias("cds_pos"), o["n"].alias("n"))
        return F.struct((s["t"] + F.when(o["op"] == "I", 0).otherwise(o["n"])).alias("t"), F.when(o["op"].isin("I", "D"), F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"))

    zero = F.struct(F.col("cds_start").cast("int").alias("t"), F.array().cast("array<struct<op:string,cds_pos:int,n:int>>").alias("runs"))
    return matches.select("run_id", "query", "feature_id", F.inline(F.aggregate("ops", zero, step, lambda s: s["runs"])))


def _lost_codons(x: DataFrame) -> Column:
    codons = F.floor((F.length("cds") - F.col("codon_start")) / 3).cast("int")
    first = lambda c: F.col("codon_start") + c * 3
    bad = lambda s, c: (first(c) < F.col("cds_start")) | (first(c) + 3 > s["cds_end"]) | (F.substring(s["bases"], first(c) + 1, F.lit(3)) == "NNN")
    every = F.sequence(F.lit(0), F.greatest(codons - 1, F.lit(0)))
    # The optimizer moves what the columns are made of into the expression: bound outside, it is not made again for each codon.
    lost = let(F.struct("cds_end", "bases"), lambda s: F.filter(every, lambda c: bad(s, c)))
    return F.when(codons > 0, lost).otherwise(F.array().cast("array<int>"))


def unassessable_codons(matches: DataFrame) -> DataFrame:
    """Ranges of codons outside the alignment or read as NNN (C-2): ``run_id, feature_id, codon_start, codon_end``. ``matches`` as ``aligned`` gives them."""
    x = matches.withColumn("_lost", _lost_codons(matches))
    return merge_codon_gaps(x.select("run_id", "feature_id", F.explode("_lost").alias("codon_pos")))


def consensus_variants(matches: DataFrame) -> DataFrame:
    """Calls from aligned consensus sequences (C-1): ``run_id, query, feature_id, pos, ref, alt, af, cds_pos, query_codon``.

    ``matches`` as ``aligned`` gives them. Alleles and places are those of the genome's forward strand. Ambiguous letters give a
    call for each base they stand for. Insertions and deletions are anchored at the base before them, on the reverse strand at the one behind in coding order; without
    one, before the reading frame, or beyond the alignment's ends they are dropped, as is everything that starts in a codon that is not assessable.
    """
    x = matches.withColumn("_lost", _lost_codons(matches))
    frame, plus = F.col("codon_start"), F.col("feature_strand") != "-"
    codon = lambda p: F.floor((p - frame) / 3).cast("int")
    fine = lambda p: (p >= frame) & ~F.array_contains("_lost", codon(p))
    base = lambda p, n=1: F.substring("cds", p + 1, F.lit(n) if isinstance(n, int) else n)
    row = lambda at, ref, alt, af, kind: F.struct(at.cast("int").alias("cds_pos"), ref.alias("ref"), alt.alias("alt"), af.alias("af"), F.lit(kind).alias("kind"))
    one = F.lit(1.0)

    letters = F.zip_with(F.split("cds", ""), F.split("bases", ""), lambda r, q: F.struct(r.alias("r"), q.alias("q")))
    differ = F.filter(F.transform(letters, lambda z, i: F.struct(i.alias("p"), z["r"].alias("r"), z["q"].alias("q"))), lambda z: (z["r"] != z["q"]) & ~z["q"].isin("-", "") & fine(z["p"]))
    snps = F.flatten(F.transform(differ, lambda z: F.transform(S.iupac_alts(z["r"], z["q"]), lambda a: row(z["p"], z["r"], a["alt"], a["af"], "snp"))))

    before = lambda i: F.when(plus, i["at"] - 1).otherwise(i["at"])
    placed = F.filter("insertions", lambda i: (i["at"] < F.length("cds")) & fine(i["at"]) & (before(i) >= frame))
    ins = F.transform(placed, lambda i: row(before(i), base(before(i)), F.concat(base(before(i)), i["text"]), one, "insertion"))

    def runs(s: Column, o: Column) -> Column:
        run = F.struct(s["t"].alias("p"), o["n"].alias("n"))
        return F.struct((s["t"] + F.when(o["op"] == "I", 0).otherwise(o["n"])).alias("t"), F.when(o["op"] == "D", F.concat(s["runs"], F.array(run))).otherwise(s["runs"]).alias("runs"))

    zero = F.struct(F.col("cds_start").cast("int").alias("t"), F.array().cast("array<struct<p:int,n:int>>").alias("runs"))
    gone = F.aggregate("ops", zero, runs, lambda s: s["runs"])
    anchor = lambda g: F.when(plus, g["p"] - 1).otherwise(g["p"] + g["n"])
    # Gaps that reach the alignment's end go on outside of it.
    inner = lambda g: ((g["p"] > F.col("cds_start")) | (F.col("cds_start") == 0)) & ((g["p"] + g["n"] < F.col("cds_end")) | (F.col("cds_end") == F.length("cds")))
    held = F.filter(gone, lambda g: inner(g) & fine(g["p"]) & (anchor(g) >= frame) & (anchor(g) < F.length("cds")))
    dels = F.transform(held, lambda g: row(anchor(g), F.concat(base(anchor(g)), base(g["p"], g["n"])), base(anchor(g)), one, "deletion"))

    text = F.substring("bases", frame + codon(F.col("cds_pos")) * 3 + 1, F.lit(3))
    x = x.select("run_id", "query", "feature_id", "feature_strand", "segments", "codon_start", "bases", F.inline(F.concat(snps, ins, dels)))
    # On the reverse strand the anchor stays in front and what follows it turns round.
    turned = lambda c: F.when(plus, F.col(c)).otherwise(F.concat(S.complement(F.substring(c, 1, 1)), S.reverse_complement(F.substring(c, 2, 2**30))))
    query_codon = F.when((F.col("kind") == "snp") & ~text.contains("-") & (F.length(text) == 3), text).otherwise("")
    return x.select("run_id", "query", "feature_id", cds_to_genomic(F.col("segments"), F.col("feature_strand"), F.col("cds_pos")).alias("pos"), turned("ref").alias("ref"), turned("alt").alias("alt"), "af", "cds_pos", query_codon.alias("query_codon"))
