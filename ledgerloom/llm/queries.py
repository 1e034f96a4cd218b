"""The queries of this subpackage: opN_<name>(spark, sf_dir) applies operator N to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontam, filter_audit, fingerprints, importance, langid, license_scan, packing, quality, simhash_dedup, token_counts, toxicity, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license notice in the documents with its differences from the template."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


#: (verdict, host, path), as the contract of op2 names them.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url with the rule that fits and the verdict."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, "page_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its SimHash and its component of near-duplicates."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of greedy word pieces."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of each document with its place in a sequence of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity score with its nearest labelled examples."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint beside its edited text's and the next document's."""
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that a passage of the document copies, with the passage's place."""
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's predicted language."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, as read back from the archives."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score with its distances to both classes."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weight towards the benchmark's words, its score and its place in the draw."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_url_filter, op3_simhash_dedup, op4_token_counts, op5_best_fit_packing, op6_toxicity, op7_fingerprints, op8_decontamination, op9_language_id, op10_warc, op11_quality, op12_importance_resampling, op13_filter_audit)}

ORACLES = {
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT page_id, cast(octet_length(encode(h)) AS bigint) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        m AS (SELECT payload_digest AS d, max(page_id) AS first FROM r WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first IS NULL OR first = page_id THEN NULL ELSE first END AS refers_to
        FROM r LEFT JOIN m ON payload_digest = d""",
    "op12_importance_resampling": r"""
        WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
        e AS (SELECT doc_id, unnest(w) AS f FROM d),
        v AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM e UNION SELECT f FROM b)),
        y AS (SELECT f, list_transform(range(length(x) // 2), lambda i: cast('0x' || substr(x, cast(2 * i + 1 AS int), 2) AS bigint)) AS bytes FROM v),
        k AS (SELECT f, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, z: xor(c >> 8, t[(xor(c, z) & 255) + 1])), 4294967295) % 10000 AS bucket FROM y, tbl),
        s AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
        g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1.0::double) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket)),
        w AS (SELECT doc_id, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM e JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
        r AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, cast(coalesce(weight, 0) AS bigint) AS weight, cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS bigint) AS h FROM d LEFT JOIN w USING (doc_id)),
        z AS (SELECT doc_id, n_features, weight, cast(weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) AS bigint) AS score FROM r),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM z WHERE n_features >= 20)
        SELECT doc_id, cast(n_features AS bigint) AS n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM z LEFT JOIN o USING (doc_id)""",
    "op13_filter_audit": r"""
        WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
        d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(doc_id > first, false) AS E
              FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, A::int + 2 * B::int + 4 * C::int + 8 * D::int + 16 * E::int AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
        o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
        s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS filter, (1 << (ascii(substr(filter_order, k, 1)) - 65)) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(substr(filter_order, cast(j AS int), 1)) - 65))), 0)::int AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        m AS (SELECT part, filter_order, step, filter, mask & bit > 0 AS fails, mask & before > 0 AS gone, mask = bit AS single, n, good, toxic FROM c, s),
        p AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (single), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost FROM m GROUP BY ALL)
        SELECT part, filter_order, step, filter, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails, good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley FROM p""",
}
