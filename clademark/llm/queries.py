"""Registered queries of the training-data operators and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, divergence, language, lines, minhash, packing, sharding, suffix, toxicity, urls, vectors, warc
from ._store import new_path, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of ``documents`` by ``benchmark``."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that strings of 400 bytes cover which occur more than once, and repeated passages of over 50 words."""
    return suffix.repeats_and_passages(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of ``documents`` in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of ``documents``, learned from ``labels``."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 24 shuffled shards."""
    out = sharding.documents(_table(spark, sf_dir, "documents"))
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of ``pages``."""
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages"), rules).drop("alias_of")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``embeddings``."""
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to archives and read back."""
    with scratch(spark) as kept:
        path = new_path(spark, "warc")
        warc.write(_table(spark, sf_dir, "pages"), path)
        got = warc.captures(warc.records(spark, path), bodies=False)
        size = F.coalesce("origin.bytes", "bytes")
        rows = got.select(warc.page_id_of(F.col("metadata.fields")).alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), warc.page_id_of(F.col("origin.fields")).alias("refers_to"))
        return kept(rows, "pages")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over ``documents``, aligned."""
    import public_tokenizers

    path = public_tokenizers.path
    out = alignment.align(_table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_links") == 0, "").otherwise(F.sha2(F.encode("groups", "utf-8"), 256))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without lines that many of them hold."""
    out = lines.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the terms of the sources of ``documents`` differ."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_language": op2_language, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_sharding": op5_sharding, "op6_decontaminate": op6_decontaminate, "op7_vectors": op7_vectors, "op8_warc": op8_warc, "op9_urls": op9_urls, "op10_suffix": op10_suffix, "op11_alignment": op11_alignment, "op12_lines": op12_lines, "op13_divergence": op13_divergence}


ORACLE: dict[str, str] = {
    "op1_minhash": r"""
        WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
            ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS set FROM w),
        same AS MATERIALIZED (SELECT set, min(doc_id) AS rep, len(set) AS n FROM s WHERE len(set) > 0 GROUP BY set),
        g AS MATERIALIZED (SELECT rep, n, unnest(set) AS g FROM same),
        pairs AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS i FROM g x JOIN g y ON x.g = y.g AND x.rep <> y.rep AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 75 GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * i >= 75 * (na + nb - i)),
        low(node, c) AS (SELECT rep, rep FROM same UNION SELECT l.b, low.c FROM low JOIN links l ON l.a = low.node AND low.c < l.b),
        comp AS (SELECT node, min(c) AS c FROM low GROUP BY node)
        SELECT s.doc_id, len(s.set) AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id, s.doc_id = coalesce(comp.c, s.doc_id) AS kept
        FROM s LEFT JOIN same ON s.set = same.set LEFT JOIN comp ON comp.node = same.rep""",
    "op6_decontaminate": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[j:j + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM iw),
        dw AS MATERIALIZED (SELECT doc_id, n, j, array_to_string(w[j:j + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM d JOIN sizes ON len(w) >= n)),
        hit AS MATERIALIZED (SELECT doc_id, j, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(j, j + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_vectors": r"""
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        good AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
            WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.u) = len(y.u) AND x.vec_id <> y.vec_id WHERE list_dot_product(x.u, y.u) >= 0.93),
        low(node, c) AS (SELECT vec_id, vec_id FROM good UNION SELECT l.b, low.c FROM low JOIN links l ON l.a = low.node AND low.c < l.b),
        comp AS (SELECT node, min(c) AS c FROM low GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.c, v.vec_id) AS component_id, v.vec_id = coalesce(comp.c, v.vec_id) AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN comp ON comp.node = v.vec_id""",
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, upper(sha1(coalesce(html, ''))) AS x FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            CAST(CAST('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) // CAST(pow(32, 3 - j) AS BIGINT) % 32 AS INT) + 1, 1)), '')), '') AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    # The tables name no canonical address and no redirect, so that components hold one page each.
    "op9_urls": r"""
        WITH rules(rhost, rpath, decision) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
        SELECT p.page_id, p.host, p.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
            coalesce(max_by(decision, length(rhost || rpath)), 'allow') AS verdict
        FROM parsed p LEFT JOIN rules r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
        GROUP BY ALL""",
    "op12_lines": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS MATERIALIZED (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        o AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id <> last) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
        FROM k LEFT JOIN o USING (key) GROUP BY doc_id""",
    "op13_divergence": r"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS MATERIALIZED (SELECT doc_id, lang, source, term, count(*) AS n FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
        k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM k GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, source, term, sum(n) AS c FROM t JOIN k USING (lang, term) GROUP BY ALL),
        g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS own_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
        f AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + 1000000000 * (coalesce(c, 0) + 1) // (own_n + v) AS p, 1 + 1000000000 * (total + 1) // (lang_n + v) AS q
            FROM g JOIN langs USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM f x JOIN f y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM f WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 200""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
