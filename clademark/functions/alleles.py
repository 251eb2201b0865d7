"""Column functions on the alleles of rules and annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY_INSERTION = "INS_any"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` in the expression once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_frameshift_token(token: Column) -> Column:
    """``fsX``, also after one anchor letter."""
    return F.upper(token).rlike(r"^.?FSX$")


def payload(short: Column, long: Column) -> Column:
    """What the longer allele has beyond the shorter one: the rest after it, or as many letters from the end."""
    extra = F.greatest(F.length(long) - F.length(short), F.lit(0))
    return F.when(long.startswith(short), F.substring(long, F.length(short) + 1, extra)).otherwise(F.right(long, extra))


def alleles_match(rule_ref: Column, rule_mut: Column, ann_ref: Column, ann_alt: Column, consequence: Column) -> Column:
    """Does an annotation fulfil a rule at the same codon (F-12)?

    Frameshifts meet frameshift rules only. In-frame insertions and deletions meet rules of their kind by what is
    inserted or deleted, whatever the anchor, and the any-insertion rule meets every insertion. All else meets by the resulting amino
    acids, or, for a deletion rule, by the block it deletes. Null alleles count as empty.
    """
    r, m, a, b = (F.coalesce(c, F.lit("")) for c in (rule_ref, rule_mut, ann_ref, ann_alt))
    kind = F.coalesce(consequence, F.lit(""))
    longer, shorter = F.length(m) > F.length(r), F.length(r) > F.length(m)
    by_state = F.when(longer | ((F.length(r) == 1) & (F.length(m) == 1)), b == m).when(shorter, a == r).otherwise((a == r) & (b == m))
    return (
        F.when(kind == "frameshift", is_frameshift_token(m) & is_frameshift_token(b))
        .when(m == ANY_INSERTION, kind == "insertion")
        .when((kind == "insertion") & longer, payload(r, m) == payload(a, b))
        .when((kind == "deletion") & shorter, payload(m, r) == payload(b, a))
        .otherwise(by_state)
    )


def normalize_mutation(raw: Column, reference: Column, position: Column) -> Column:
    """Canonical form of a mutation as people write it, or null if it is not understood (F-8).

    ``A`` (amino acid), ``*`` (stop), ``fsX``, ``F50FGG`` (insertion after F50), ``FGG50F`` (deletion),
    ``INS_any``. An insertion without anchor takes it from ``reference`` and the 1-based ``position``; deletions
    without their letters are not understood, nor are ``X`` and stops or frameshifts with a place but no letter before it.

    A mutation with a place is residues, number, perhaps a second place, perhaps a word, and residues.
    """
    return let(F.upper(F.trim(raw)), lambda s: _placed(s, F.upper(F.trim(F.coalesce(reference, F.lit("")))), position))


def _placed(s: Column, ref: Column, position: Column) -> Column:
    pattern = r"^([A-Z*]*)(\d+)(_[A-Z*]\d+)?(INS|DEL|STOP|FRAMESHIFT|FS)?(.*)$"
    part = lambda i: F.regexp_extract(s, pattern, i)
    parts = F.struct(*(part(i).alias(n) for i, n in enumerate(("left", "place", "second", "word", "rest"), 1)), F.concat(part(4), part(5)).alias("right"))
    return let(parts, lambda p: _canonical(s, ref, position, *(p[n] for n in ("left", "place", "second", "word", "rest", "right"))))


def _canonical(s: Column, ref: Column, position: Column, left: Column, place: Column, second: Column, word: Column, rest: Column, right: Column) -> Column:
    anchored, single = F.length(left) == 1, second == ""
    resized = (right.startswith(left) & (F.length(right) > F.length(left))) | (left.startswith(right) & (F.length(left) > F.length(right)))
    placed = (
        F.when(place == "", F.lit(None))
        .when(anchored & single & word.isin("FS", "FRAMESHIFT"), "fsX")
        .when(anchored & single & (right == "STOP"), "*")
        .when(~rest.rlike(r"^[A-Z*]*$"), F.lit(None))
        .when(anchored & (word == "INS") & (rest != ""), F.concat(left, place, left, rest))
        .when(anchored & (word == "DEL"), F.when(rest != "", F.concat(left, rest, place, left)))
        .when(single & anchored & (F.length(right) == 1), right)
        .when(single & (left != "") & (right != "") & resized, F.concat(left, place, right))
    )
    bare = F.trim(F.substring(s, 4, 2**30))
    alone = (
        F.when(s.isin("*", "STOP"), "*").when(s == "INS_ANY", ANY_INSERTION)
        .when(s.startswith("INS") & (bare != "") & (ref != "") & position.isNotNull(), F.concat(ref, position.cast("string"), ref, bare))
        .when(s.rlike("^[A-WYZ]$"), s)
    )
    return (
        F.when(s.rlike(r"^(FS|FRAMESHIFT)"), "fsX")
        .otherwise(F.coalesce(placed, alone))
    )
