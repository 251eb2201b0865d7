"""Metadata of knowledge bases with the settings of their interpretation, from JSON files (S-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import _lookup, phenotype_label

# The keys of a metadata file and other ways to write them, names and methods of settings, and effects that may count as resistant.
KEYS = {
    "maintainers": "maintainers", "maintainer": "maintainers", "contact": "contact", "publication": "publication_pmid", "publication_pmid": "publication_pmid", "pmid": "publication_pmid", "website": "website",
    "description": "description", "maintainer_update": "maintainer_update", "maintainer update": "maintainer_update", "license": "license", "tsv_checksum": "tsv_checksum", "tsv checksum": "tsv_checksum",
    "interpretation_algorithms": "interpretation_algorithms",
}
NAMES = ("drug_groups", "drug_interpretation", "drug_alias", "effect_as_resistant")
METHODS = ("by_phenotype", "by_score", "by_ic50", "by_fold_ic50")
EFFECTS = ("frameshift", "stop_gained", "stop_lost", "start_lost", "insertion", "deletion")


def _each(rows: DataFrame, column: str, keep: list[str], key: str, value: str) -> DataFrame:
    """A row for each member of an object or list; ``key`` is null in a list."""
    x = rows.select(*keep, F.col(column).alias("_v")).filter("_v is not null")
    out = x.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return out.select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias(key), F.col("value").alias(value))


def _text(v: str, path: str = "$") -> Column:
    """A member that is a text, trimmed; null if it is something else."""
    at = F.try_variant_get(F.col(v), path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.trim(F.try_variant_get(at, "$", "string")))


def _member(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "variant")


def _given(c: Column) -> Column:
    return c.isNotNull() & (F.schema_of_variant(c) != "VOID")


def read_metadata_json(spark: SparkSession, paths) -> dict[str, DataFrame]:
    """Tables of metadata files, one knowledge base in each: ``metadata`` (``file, key, value``), ``thresholds`` (``file, method, reference, drug, label, value``, null reference and drug for the defaults), ``effect_rules``
    (``file, feature, effect, reference, drug``), ``drug_groups`` (``file, drug_group, drug``), ``drug_aliases`` (``file, drug, alias``) and ``problems`` (``file, place, problem``).

    Keys are read without regard to case, with ``-`` for ``_`` and by the names of ``KEYS``; others are a problem, as are values of another kind, unknown settings and settings that come twice. Labels are stored as rules have them.
    What thresholds must be to each other is left to ``check_settings``.
    """
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    top = raw.withColumn("kind", F.schema_of_variant("v"))
    object_ = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    problems = [top.filter(~object_).select("file", F.lit("").alias("place"), F.when(F.col("v").isNull(), "not JSON").otherwise("no object").alias("problem"))]
    bad = lambda rows, place, problem, *when: problems.append(rows.filter(*when).select("file", place.alias("place"), F.lit(problem).alias("problem")))

    x = _each(top.filter(object_), "v", ["file"], "written", "v").withColumn("key", _lookup(KEYS, F.replace(F.lower(F.trim("written")), F.lit("-"), F.lit("_")))).withColumn("kind", F.schema_of_variant("v"))
    bad(x, F.col("written"), "unknown key", F.col("key").isNull())
    plain = x.filter("key <> 'interpretation_algorithms' and kind <> 'VOID'")
    list_ = F.array_join(F.filter(F.transform(F.try_variant_get("v", "$", "array<string>"), lambda y: F.trim(y)), lambda y: y != ""), "; ")
    value = (
        F.when((F.col("key") == "maintainers") & F.col("kind").isin("ARRAY<STRING>", "ARRAY<VOID>"), list_)
        .when((F.col("key") == "publication_pmid") & F.col("kind").isin("STRING", "BIGINT"), F.when(F.trim(F.try_variant_get("v", "$", "string")).rlike(r"^\d*$"), F.trim(F.try_variant_get("v", "$", "string"))))
        .when((F.col("key") != "publication_pmid") & (F.col("kind") == "STRING"), _text("v"))
    )
    plain = plain.withColumn("value", value)
    bad(plain, F.col("written"), "value of another kind", F.col("value").isNull())
    metadata = plain.filter("value <> ''").select("file", "key", "value")

    settings = x.filter("key = 'interpretation_algorithms' and kind <> 'VOID'")
    bad(settings, F.col("written"), "no list", ~F.col("kind").startswith("ARRAY"))
    items = _each(settings.filter(F.col("kind").startswith("ARRAY")), "v", ["file"], "place", "v").withColumns({"name": _text("v", "$.name"), "method": _text("v", "$.method")})
    known = F.coalesce(F.col("name").isin(*NAMES), F.lit(False))
    bad(items, F.col("place"), "unknown setting", ~known)
    again = items.filter(known).groupBy("file", "name", F.when(F.col("name") == "drug_interpretation", F.col("method")).alias("method")).agg(F.count("*").alias("n"))
    bad(again, F.concat_ws(" ", "name", "method"), "setting comes twice", F.col("n") > 1)

    read = items.filter("name = 'drug_interpretation'")
    bad(read, F.col("place"), "unknown method", ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)))
    read = read.withColumns({"t": _member("v", "$.thresholds"), "o": _member("v", "$.drug_thresholds")})
    bad(read, F.col("place"), "thresholds of phenotypes", (F.col("method") == "by_phenotype") & (F.col("t").isNotNull() | _given(F.col("o"))))
    read = read.filter(F.col("method").isin(*METHODS[1:]))
    bad(read, F.col("place"), "no thresholds", ~F.coalesce(F.schema_of_variant("t").startswith("OBJECT<") & (F.schema_of_variant("t") != "OBJECT<>"), F.lit(False)))
    own = _each(read, "o", ["file", "place", "method"], "no", "v").withColumns({"reference": _text("v", "$.reference"), "drug": _text("v", "$.drug"), "t": _member("v", "$.thresholds")})
    bad(own, F.concat_ws(".", "place", "no"), "override without drug", F.coalesce("drug", F.lit("")) == "")
    bad(own, F.concat_ws(".", "place", "no"), "override without thresholds", F.col("t").isNull())
    sets = read.select("file", "place", "method", F.lit(None).cast("string").alias("reference"), F.lit(None).cast("string").alias("drug"), "t").unionByName(own.filter("drug <> ''").select("file", "place", "method", F.nullif("reference", F.lit("")).alias("reference"), "drug", "t"))
    values = _each(sets.filter(F.schema_of_variant("t").startswith("OBJECT")), "t", ["file", "place", "method", "reference", "drug"], "written", "v")
    number = F.when(~F.schema_of_variant("v").isin("STRING", "BOOLEAN"), F.try_variant_get("v", "$", "double"))
    values = values.withColumns({"label": F.nullif(phenotype_label(F.col("written")), F.lit("")), "value": number})
    bad(values, F.concat_ws(".", "place", "written"), "unknown label", F.col("label").isNull())
    bad(values, F.concat_ws(".", "place", "written"), "no number", F.col("value").isNull())
    thresholds = values.filter("label is not null and value is not null").select("file", "method", "reference", "drug", "label", "value")

    rules = _each(items.filter("name = 'effect_as_resistant'").withColumn("r", _member("v", "$.rules")), "r", ["file", "place"], "no", "v")
    rules = rules.withColumns({c: _text("v", f"$.{c}") for c in ("feature", "reference", "drug")}).withColumn("effect", F.try_variant_get("v", "$.effect", "array<string>"))
    spot = F.concat_ws(".", "place", "no")
    whole = (F.coalesce("feature", F.lit("")) != "") & (F.coalesce("reference", F.lit("")) != "") & (F.coalesce("drug", F.lit("")) != "") & (F.coalesce(F.size("effect"), F.lit(0)) > 0)
    bad(rules, spot, "effect rule lacks a value", ~whole)
    twice = rules.filter(whole).groupBy("file", "feature", "reference", "drug").agg(F.count("*").alias("n"))
    bad(twice, F.concat_ws(" ", "feature", "reference", "drug"), "effect rule comes twice", F.col("n") > 1)
    effects = rules.filter(whole).select("file", "place", "no", "feature", "reference", "drug", F.explode("effect").alias("effect")).withColumn("effect", F.trim("effect"))
    bad(effects, spot, "unknown effect", ~F.coalesce(F.col("effect").isin(*EFFECTS), F.lit(False)))
    effect_rules = effects.filter(F.col("effect").isin(*EFFECTS)).select("file", "feature", "effect", "reference", "drug")

    group = items.filter("name in ('drug_groups', 'drug_alias')").withColumn("g", _member("v", "$.groups"))
    bad(group, F.col("place"), "no groups", ~F.coalesce(F.schema_of_variant("g").startswith("OBJECT<") & (F.schema_of_variant("g") != "OBJECT<>"), F.lit(False)))
    members = _each(group.filter("name = 'drug_groups'"), "g", ["file"], "drug_group", "v")
    bad(members, F.col("drug_group"), "group without drugs", F.schema_of_variant("v") != "ARRAY<STRING>")
    drug_groups = members.filter(F.schema_of_variant("v") == "ARRAY<STRING>").select("file", "drug_group", F.explode(F.try_variant_get("v", "$", "array<string>")).alias("drug"))
    bad(drug_groups.groupBy("file", "drug").agg(F.count("*").alias("n")), F.col("drug"), "drug comes twice", F.col("n") > 1)
    aliases = _each(group.filter("name = 'drug_alias'"), "g", ["file"], "drug", "v").withColumn("alias", _text("v"))
    bad(aliases, F.col("drug"), "no alias", (F.trim("drug") == "") | (F.coalesce("alias", F.lit("")) == ""))
    drug_aliases = aliases.filter("trim(drug) <> '' and alias <> ''").select("file", "drug", "alias")
    bad(drug_aliases.groupBy("file", "alias").agg(F.count("*").alias("n")), F.col("alias"), "alias comes twice", F.col("n") > 1)
    wrong = problems[0]
    for p in problems[1:]:
        wrong = wrong.unionByName(p)
    return {"metadata": metadata, "thresholds": thresholds, "effect_rules": effect_rules, "drug_groups": drug_groups, "drug_aliases": drug_aliases, "problems": wrong}
