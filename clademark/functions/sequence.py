"""Column functions on sequences, alleles, labels and numbers."""

from __future__ import annotations

from itertools import chain, product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in the order TCAG.
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), GENETIC_CODE, strict=True)}

# IUPAC nucleotide letters and the bases they stand for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}

# Phenotype labels and their ranks; 0 is unknown, -1 contradictory.
PHENOTYPE_RANKS = {
    "susceptible": 1, "sensitive": 1, "normal inhibition": 1, "ni": 1, "normal": 1,
    "potential low-level resistance": 2, "possibly resistant": 2, "suspected reduced": 2,
    "low-level resistance": 3, "reduced susceptibility": 3, "limited susceptibility": 3,
    "intermediate": 4, "intermediate resistance": 4, "reduced inhibition": 4, "ri": 4,
    "resistant": 5, "high-level resistance": 5, "highly reduced inhibition": 5, "hri": 5,
    "unknown": 0, "not analysed": 0, "none": 0, "": 0, "contradictory": -1, "conflicting": -1,
}

# The label that stands for a rank.
RANK_LABELS = {1: "susceptible", 2: "potential low-level resistance", 3: "low-level resistance", 4: "intermediate", 5: "resistant", 0: "unknown", -1: "contradictory"}

# Inclusive frequency bins of variant calls and of consensus sequences.
AF_BINS = {"high": (0.75, 1.0), "intermediate": (0.25, 0.7499), "low": (0.01, 0.2499)}
AF_BINS_FASTA = {"high": (0.75, 1.0), "intermediate": (0.35, 0.74), "low": (0.01, 0.34)}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def _ambiguous(c: Column) -> Column:
    """Amino acid of a codon with IUPAC letters: of all codons that it stands for, if it is the same."""
    options = lambda i: F.split(F.coalesce(_lookup(IUPAC, F.substring(c, i, 1)), F.lit("")), "")
    each = F.flatten(F.transform(options(1), lambda a: F.flatten(F.transform(options(2), lambda b: F.transform(options(3), lambda d: _lookup(CODONS, F.concat(a, b, d)))))))
    seen = F.array_join(F.array_sort(F.array_distinct(each)), "")
    # Letters for either of two amino acids.
    return F.when(F.length(seen) == 1, seen).when(seen == "DN", "B").when(seen == "EQ", "Z").when(seen == "IL", "J").otherwise("X")


def translate_codon(codon: Column) -> Column:
    """Amino acid, ``*`` for a stop, ``-`` for three gaps, ``?`` for what is no codon (F-1).

    A codon with ambiguous letters is the amino acid of all that it stands for, ``B``, ``Z`` or ``J`` for two that have a letter, else ``X``.
    """
    c = F.upper(codon)
    letters = "".join(IUPAC)
    return F.coalesce(_lookup(CODONS, c), F.when(c == "---", "-").when(c.rlike(f"^[{letters}]{{3}}$"), _ambiguous(c)).otherwise("?"))


def translate_seq(seq: Column) -> Column:
    """Amino acids of the whole codons of a sequence; a rest is ignored (F-2)."""
    n = F.floor(F.length(seq) / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: translate_codon(F.substring(seq, i * 3 + 1, F.lit(3))))
    return F.when(n > 0, F.array_join(each, "")).otherwise("")


def letters(seq: Column, at: Column, n: Column) -> Column:
    """``n`` letters of a sequence from the 1-based place ``at``, as ``substring``; by bytes, which letters of sequences are, as a text would be counted from its start each time."""
    return F.substring(seq.cast("binary"), at, n).cast("string")


def complement(seq: Column) -> Column:
    return F.translate(F.upper(seq), "ACGTRYKMBVDHN", "TGCAYRMKVBHDN")


def reverse_complement(seq: Column) -> Column:
    """Of IUPAC letters; gaps stay (F-3)."""
    return F.reverse(complement(seq))


def allele_kind(ref: Column, alt: Column) -> Column:
    """``snp``, ``insertion``, ``deletion`` or ``mnv`` (F-4)."""
    a, b = F.length(ref), F.length(alt)
    return F.when((a == 1) & (b == 1), "snp").when(b > a, "insertion").when(b < a, "deletion").otherwise("mnv")


def classify_snp(ref_aa: Column, alt_aa: Column, codon: Column) -> Column:
    """Consequence of an exchange (F-5); the order of the tests matters."""
    unknown = ref_aa.isin("?", "") | alt_aa.isin("?", "")
    return (
        F.when(unknown, "unknown").when(ref_aa == alt_aa, "synonymous").when((codon == 0) & (ref_aa == "M"), "start_lost")
        .when(alt_aa == "*", "stop_gained").when(ref_aa == "*", "stop_loss").otherwise("missense")
    )


def is_nucleotide_alt(alt: Column) -> Column:
    """Usable ALT: not empty, ``.``, ``*``, symbolic or a breakend (P-2)."""
    return F.coalesce(~alt.isin("", ".", "*") & ~alt.rlike(r"^<.*>$|[\[\]]"), F.lit(False))


def af_bin(freq: Column, bins: dict[str, tuple[float, float]] | None = None) -> Column:
    """Name of the bin with inclusive bounds, high first; ``''`` in the holes between (F-19)."""
    out = F.lit("")
    for name, (lo, hi) in reversed((bins or AF_BINS).items()):
        out = F.when((freq >= lo) & (freq <= hi), name).otherwise(out)
    return out


def label_to_rank(label: Column) -> Column:
    """Rank of a phenotype label, 0 if unknown (F-20)."""
    return F.coalesce(_lookup(PHENOTYPE_RANKS, F.lower(F.trim(label))), F.lit(0))


def rank_to_label(rank: Column) -> Column:
    """The label that stands for a rank; ``unknown`` for others (F-20)."""
    return F.coalesce(_lookup(RANK_LABELS, rank.cast("int")), F.lit(RANK_LABELS[0]))


def phenotype_label(text: Column) -> Column:
    """A label as stored: lower case, other words for unknown as ``unknown``, a bare rank from 1 to 5 as its label, blank as ``''``; null if it is none of these (F-20)."""
    key = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    rank = _lookup(PHENOTYPE_RANKS, key)
    return F.when(key == "", "").when(rank == 0, RANK_LABELS[0]).when(rank.isNotNull(), key).when(key.rlike(r"^0*[1-5]$"), rank_to_label(key.try_cast("int")))


def strength(rank: Column) -> Column:
    """Order of ranks: contradictory lies between 1 and 2, unknown is lowest (K-6)."""
    return F.when(rank == -1, 1.5).otherwise(F.coalesce(rank, F.lit(0)).cast("double"))


def leading_number(text: Column) -> Column:
    """Number at the start of a text, after qualifiers such as ``>`` or ``~`` (F-21)."""
    return F.regexp_extract(text, r"^[\s><=~≥≤≈]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def _significant(number: Column) -> Column:
    """``%g`` in other words: six significant digits without zeros at the end, with an exponent below -4 and from 6."""
    parts = F.split(F.format_string("%.5e", F.abs(number)), "e")
    power = F.get(parts, F.lit(1)).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(0)), r"\.", ""), "0+$", "")
    put = lambda whole, rest: F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    large = put(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.substring(digits, power + 2, F.lit(6)))
    other = F.concat(put(F.substring(digits, 1, 1), F.substring(digits, 2, 6)), F.lit("e"), F.get(parts, F.lit(1)))
    text = F.when((power < -4) | (power >= 6), other).when(power < 0, small).otherwise(large)
    return F.when(number == 0, "0").otherwise(F.concat(F.when(number < 0, "-").otherwise(""), text))


def number_in(text: Column) -> Column:
    """The first number in a text as it is stored; blank and ``none`` are ``''``, and null is what has no number (F-21, as rules are imported)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(t, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0).try_cast("double")
    return F.when((t == "") | (F.lower(t) == "none"), "").when(found.isNotNull(), _significant(found))


def number_as_stored(text: Column) -> Column:
    """A score as it is stored: the whole text must be a number; blank and ``none`` are ``''`` (F-21)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when((t == "") | (F.lower(t) == "none"), "").when(t.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), _significant(t.try_cast("double")))


def number_or_percent(text: Column) -> Column:
    """``12.5%`` is 0.125 (F-18)."""
    t = F.trim(text)
    number = F.regexp_replace(t, "%$", "").try_cast("double")
    return F.when(t.endswith("%"), number / 100).otherwise(number)


def accession_base(name: Column) -> Column:
    """Accession without its version (F-22)."""
    return F.regexp_replace(F.trim(name), r"\.\d+$", "")


def safe_stem(path: Column) -> Column:
    """File name without folders and its last extension (F-29)."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def codon_index(cds: Column, codon_start: Column) -> Column:
    return F.floor((cds - codon_start) / 3).cast("int")


def codon_position(cds: Column, codon_start: Column) -> Column:
    return F.pmod(cds - codon_start, F.lit(3)).cast("int")


def iupac_alts(ref: Column, query: Column) -> Column:
    """Bases a letter stands for, but for the reference, sorted, each with its share of all of them (F-13)."""
    options = F.split(F.coalesce(_lookup(IUPAC, F.upper(query)), F.upper(query)), "")
    other = F.filter(options, lambda o: o != F.upper(ref))
    return F.transform(other, lambda o: F.struct(o.alias("alt"), (F.lit(1.0) / F.size(options)).alias("af")))


def sequence_checksum(seq: Column) -> Column:
    """SHA-256 of the sequence in capitals (F-27)."""
    return F.sha2(F.upper(seq), 256)


def doi_of(token: Column) -> Column:
    """DOI of a publication token, without address or ``doi:`` before it; else empty (F-23)."""
    return F.trim(F.regexp_extract(F.trim(token), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:)(.*)$", 1))


def pmid_of(token: Column) -> Column:
    """PubMed id after ``PMID:``; else empty (F-23)."""
    return F.trim(F.regexp_extract(F.trim(token), r"(?i)^pmid:(.*)$", 1))
