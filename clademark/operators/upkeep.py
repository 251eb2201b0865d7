"""Upkeep of knowledge bases and stored runs: memos, enrichment, extension, evidence and renewed hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import sequence_checksum
from .formulas import evaluate_formulas
from .rules import best_member_evidence, effect_hits, match_rules


def _filled(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns], F.lit(""))


def with_cached_matches(queries: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches that the memo has, queries it has none for) (S-16). ``queries``: ``run_id, query, sequence``; ``memo``: ``checksum`` and the match. The key is the sequence alone, whatever its name."""
    x = queries.withColumn("checksum", sequence_checksum(F.col("sequence")))
    return x.drop("sequence").join(memo, "checksum"), x.join(memo.select("checksum").distinct(), "checksum", "left_anti")


def enrich_publications(publications: DataFrame, crossref: DataFrame, pubmed: DataFrame) -> DataFrame:
    """Publications with what two offline tables know of them (S-17): ``publication_id, doi, pmid, title, year``.

    ``crossref``: ``doi, title, year``; ``pubmed``: ``pmid, doi, title, year``. A missing DOI comes from the PubMed id and the other way round; titles and years of the first table count before those of the
    second. DOIs meet without regard to case; of several rows for a key one is taken.
    """
    doi = lambda c: F.lower(F.trim(c))
    by_id = pubmed.groupBy(F.trim(F.col("pmid").cast("string")).alias("_p")).agg(F.min(F.struct("doi", "title", "year")).alias("m"))
    by_doi = pubmed.filter(F.coalesce("doi", F.lit("")) != "").groupBy(doi("doi").alias("_d")).agg(F.min(F.struct(F.col("pmid").cast("string").alias("pmid"), "title", "year")).alias("n"))
    cross = crossref.groupBy(doi("doi").alias("_d")).agg(F.min(F.struct("title", "year")).alias("c"))
    x = publications.withColumn("_p", F.nullif(_filled("pmid"), F.lit(""))).join(by_id, "_p", "left").withColumn("_m_doi", F.col("m.doi"))
    x = x.withColumn("doi", _filled("doi", "_m_doi")).withColumn("_d", F.nullif(doi("doi"), F.lit(""))).join(by_doi, "_d", "left").join(cross, "_d", "left")
    x = x.withColumns({"_a": F.col("c.title"), "_b": F.col("m.title"), "_c": F.col("n.title"), "_n": F.col("n.pmid")})
    return x.select("publication_id", "doi", _filled("_p", "_n").alias("pmid"), _filled("_a", "_b", "_c").alias("title"), F.coalesce("c.year", "m.year", "n.year").alias("year"))


def extend_features(stored: DataFrame, incoming: DataFrame, same: list[str], fill: list[str], key: str = "name") -> DataFrame:
    """A knowledge base's features with incoming ones (T-1): ``status`` is ``stored``, ``new`` or ``conflict``.

    Features of one ``key`` must agree in the columns ``same``; blank ``fill`` columns take the incoming value. A conflict keeps the stored row and forbids the write; the
    new version is written to a folder of its own, so that readers see the old one or the new one.
    """
    a, b = stored.alias("a"), incoming.alias("b")
    x = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    here, there = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    status = F.when(here & there & differ, "conflict").when(here, "stored").otherwise("new")
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    cols = [F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(here, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in same], *[F.coalesce(blank(f"a.{c}"), F.when(status != "conflict", blank(f"b.{c}")), F.lit("")).alias(c) for c in fill]]
    return x.select(*cols, status.alias("status"))


def backfill_segments(features: DataFrame) -> DataFrame:
    """Features without segments get one from start to end (T-5)."""
    one = F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end")))
    kind = features.schema["segments"].dataType
    return features.withColumn("segments", F.when(F.coalesce(F.size("segments"), F.lit(0)) > 0, F.col("segments")).otherwise(one.cast(kind)))


def reattach_evidence(hits: DataFrame, ann: DataFrame) -> DataFrame:
    """Stored evidence of formulas with the annotation that it came from (J-12): adds ``ann_id`` and ``found``.

    The feature, codon, residues and frequency (six digits) must be equal; else the same without the frequency; ``found`` is ``exact``, ``place`` or ``none``. Of several annotations that of the smallest ``ann_id`` is taken.
    """
    weak = ["run_id", "feature_id", "codon_pos", "ref_aa", "alt_aa"]
    x = ann.withColumn("_af", F.round("af", 6))
    strong = x.groupBy(*weak, "_af").agg(F.min("ann_id").alias("_s"))
    loose = x.groupBy(*weak).agg(F.min("ann_id").alias("_w"))
    out = hits.withColumn("_af", F.round("af", 6)).join(strong, [*weak, "_af"], "left").join(loose, weak, "left")
    found = F.when(F.col("_s").isNotNull(), "exact").when(F.col("_w").isNotNull(), "place").otherwise("none")
    return out.withColumns({"ann_id": F.coalesce("_s", "_w"), "found": found}).drop("_af", "_s", "_w")


def resync(runs: DataFrame, stored: DataFrame, projects: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits of stored annotations by the rules as they are now, runs that were skipped) (T-6).

    Only runs of the project as it is (its ``project_uuid``, or a blank one) are renewed; the others are told with the ``reason``. ``stored``: annotations with ``run_id``.
    """
    known = projects.select("project_id", F.col("uuid").alias("_uuid"))
    x = runs.join(known, "project_id", "left")
    blank = F.coalesce(F.trim("project_uuid"), F.lit("")) == ""
    reason = F.when(F.col("_uuid").isNull(), "unknown project").when(~blank & (F.col("project_uuid") != F.col("_uuid")), "other knowledge base")
    x = x.withColumn("reason", reason)
    good = x.filter("reason is null").select("run_id")
    return match_rules(stored.join(good, "run_id", "left_semi"), rules), x.filter("reason is not null").select("run_id", "project_id", "reason")


def resync_all(runs: DataFrame, stored: DataFrame, projects: DataFrame, rules: DataFrame, formulas: DataFrame, effects: DataFrame, min_fraction: float = 2 / 3, eps: float = 1e-9) -> dict[str, DataFrame]:
    """All that rules, formulas and effects as they are now say of stored runs (T-6): ``hits``, ``formulas``, ``effects``, ``counts`` (for the runs) and ``skipped``.

    ``runs``: ``run_id, project_id, project_uuid``; ``rules`` with ``member_id``; ``formulas``: ``project_id, formula_id, postfix, atoms`` (``compiled``); ``effects``: ``feature_id, effects, drug``. Runs of another knowledge base
    are skipped as in ``resync``. ``counts`` has every renewed run, also with zeros. Nothing is gathered by run but its counts.
    """
    renewed, skipped = resync(runs, stored, projects, rules)
    good = runs.join(skipped.select("run_id"), "run_id", "left_anti").select("run_id", "project_id")
    named = rules.filter(F.coalesce("member_id", F.lit("")) != "").select("rule_id", F.col("member_id").alias("member"))
    evidence = best_member_evidence(renewed, eps).join(named.hint("merge"), "rule_id").groupBy("run_id", "member").agg(F.max("af").alias("lower"))
    fired = evaluate_formulas(good, evidence, formulas, min_fraction, eps)
    lost = effect_hits(stored.join(good.select("run_id"), "run_id", "left_semi"), effects)
    count = lambda df, name: df.groupBy("run_id").agg(F.count("*").alias(name))
    counts = good.select("run_id").join(count(renewed, "resistance_hits"), "run_id", "left").join(count(fired, "formula_hits"), "run_id", "left").join(count(lost, "effect_hits"), "run_id", "left").na.fill(0)
    return {"hits": renewed, "formulas": fired, "effects": lost, "counts": counts, "skipped": skipped}


def rebuild_hits(stored: DataFrame, schema: str = "array<struct<rule_id:bigint,drug:string,phenotype:string>>") -> DataFrame:
    """Hits from the texts that runs store them as (T-7): one row for each; a text that does not parse gives none. ``stored``: ``run_id, ann_id, drug_hits``."""
    x = stored.withColumn("_h", F.from_json("drug_hits", schema))
    return x.select("run_id", "ann_id", F.posexplode("_h").alias("hit_no", "_x")).select("run_id", "ann_id", "hit_no", "_x.*")
