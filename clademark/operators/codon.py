"""Several exchanges in one codon: what must occur together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S


def codon_groups(ann: DataFrame, keys: tuple[str, ...] = ("run_id", "feature_id", "codon_pos")) -> DataFrame:
    """Codons with exchanges at two or more places (A-1): the options of each place, alternatives and the reference with what is left."""
    per = ann.groupBy(*keys, "codon_offset", "ref_codon", "coding_alt").agg(F.max("af").alias("af"))
    grouped = per.groupBy(*keys, "ref_codon").agg(F.sort_array(F.collect_list(F.struct("codon_offset", F.col("coding_alt").alias("base"), "af"))).alias("m"))
    return grouped.filter(F.size(offsets(F.col("m"))) >= 2).select(*keys, "ref_codon", places(F.col("m")).alias("places"))


def offsets(m: Column) -> Column:
    return F.array_distinct(F.transform(m, lambda x: x["codon_offset"]))


def places(m: Column) -> Column:
    """Options of each place with exchanges ``m`` (sorted, ``codon_offset, base, af``) in the codon ``ref_codon``."""

    def place(o):
        alts = F.transform(F.filter(m, lambda x: x["codon_offset"] == o), lambda x: F.struct(x["base"].alias("base"), x["af"].alias("af")))
        left = F.greatest(F.lit(0.0), 1 - F.aggregate(alts, F.lit(0.0), lambda t, x: t + x["af"]))
        ref = F.struct(F.substring("ref_codon", o + 1, F.lit(1)).alias("base"), left.alias("af"))
        return F.struct(o.alias("codon_offset"), F.concat(alts, F.array(ref)).alias("options"))

    return F.transform(offsets(m), place)


def choices(places: Column) -> Column:
    """One option of each place, in all ways: ``codon``, ``total`` of the frequencies, the smallest as ``upper``, and number of exchanges as ``size``."""
    offset, options = lambda p: p["codon_offset"], lambda p: p["options"]
    seed = F.array(F.struct(F.col("ref_codon").alias("codon"), F.lit(0.0).alias("total"), F.lit(1.0).alias("upper"), F.lit(0).alias("size")))

    def extend(states, place):
        def one(s):
            return F.transform(options(place), lambda o: F.struct(
                F.overlay(s["codon"], o["base"], offset(place) + 1, F.lit(1)).alias("codon"),
                (s["total"] + o["af"]).alias("total"), F.least(s["upper"], o["af"]).alias("upper"),
                (s["size"] + (o["base"] != F.substring("ref_codon", offset(place) + 1, F.lit(1))).cast("int")).alias("size"),
            ))

        return F.flatten(F.transform(states, one))

    return F.aggregate(places, seed, extend)


def _lower(s: Column, k: Column) -> Column:
    return F.least(F.greatest(F.lit(0.0), s["total"] - (k - 1)), s["upper"])


def _forced(lower: Column, upper: Column) -> Column:
    return F.coalesce(F.try_divide(lower, upper), F.lit(0.0))


def _accepted(lower: Column, forced: Column, min_fraction: float, eps: float) -> Column:
    return (lower > eps) & (forced >= min_fraction - eps)


def frechet_states(groups: DataFrame, min_fraction: float = 2 / 3, eps: float = 1e-9) -> DataFrame:
    """Codons that combine the places' options, with Fréchet bounds of their frequency (A-2).

    ``lower = max(0, sum - (k - 1))``, ``upper = min``, ``forced = lower / upper``; ``accepted`` if lower is
    positive and forced is at least ``min_fraction``. States of the reference alone are included, as ``size`` 0. ``state_no`` counts a codon's states: places
    in order, in each the exchanges before the reference.
    """
    k = F.size("places")
    out = groups.select(*[c for c in groups.columns if c != "places"], k.alias("k"), F.posexplode(choices(F.col("places"))).alias("state_no", "s"))
    out = out.withColumn("lower", _lower(F.col("s"), F.col("k"))).select("*", "s.*").drop("s")
    out = out.withColumn("forced", _forced(F.col("lower"), F.col("upper")))
    return out.withColumns({"aa": S.translate_codon(F.col("codon")), "accepted": _accepted(F.col("lower"), F.col("forced"), min_fraction, eps)}).drop("total")


def frechet_list(places: Column, min_fraction: float = 2 / 3, eps: float = 1e-9) -> Column:
    """The states with exchanges of ``frechet_states`` in one list: ``state_no, codon, aa, size, lower, upper, forced, accepted``."""

    def state(s, no):
        lower = _lower(s, F.size(places))
        forced = _forced(lower, s["upper"])
        return F.struct(
            no.alias("state_no"), s["codon"].alias("codon"), S.translate_codon(s["codon"]).alias("aa"), s["size"].alias("size"), lower.alias("lower"),
            s["upper"].alias("upper"), forced.alias("forced"), _accepted(lower, forced, min_fraction, eps).alias("accepted"),
        )

    return F.filter(F.transform(choices(places), state), lambda s: s["size"] > 0)


def dedupe_states(states: DataFrame, keys: tuple[str, ...] = ("run_id", "feature_id", "codon_pos")) -> DataFrame:
    """States with one amino acid put together: lower bounds add, upper and forced are the largest, the codon is that of the first state (A-4)."""
    return states.groupBy(*keys, "aa").agg(F.sum("lower").alias("lower"), F.max("upper").alias("upper"), F.max("forced").alias("forced"), F.min_by("codon", "state_no").alias("codon"))
