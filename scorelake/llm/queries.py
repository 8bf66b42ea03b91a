"""The contract queries: thin, whole-table applications of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, decontaminate, fingerprints, jaccard, licences, media, quality, sharding, store, substring, token_counts, warc, whitening

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labelled = quality.training_rows(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, quality.fit(labelled, rows=None))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_known", F.array_join("licences", ",").alias("licences"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder = store.new_folder(spark, "warc")
    manifest = warc.write_archive(pages, folder)
    read = warc.read_archive(manifest, folder, pages.schema["page_id"].dataType.simpleString())
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_folder(spark, "media")
    rows = media.read_headers(media.write_shards(_table(spark, sf_dir, "documents"), folder), folder)
    full = media.read_features(rows, folder)
    return full.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), TOKENIZER, with_ids=False, with_text=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find_repeats(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), store.new_folder(spark, "token-cache"), TOKENIZER)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_jaccard_join, op4_license_scan, op5_warc, op6_media_columns, op7_sharding, op8_bpe, op9_substring_dedup, op10_token_counts, op11_fingerprints, op12_whitening, op13_clustering)
}

#: DuckDB list of the words of a text, as the decontamination contract has them.
_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE: dict[str, str] = {
    "op1_decontamination": rf"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
place AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, p, n FROM place JOIN win USING (n, k)),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)""",
    "op3_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
cov AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY i) AS t FROM word ANTI JOIN cov USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
}

#: One round: every vector's nearest centroid (the first of several), then whole means, rounded down.
_SQL_ROUND = r"""
p{r} AS MATERIALIZED (SELECT vec_id, q, arg_min({{'k': k, 'd': d}}, {{'d': d, 'k': k}}) AS a
  FROM (SELECT vec_id, q, k, CAST(list_sum(list_transform(range(1, 65), lambda i: (q[i] - m[i]) * (q[i] - m[i]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY vec_id, q),
c{s} AS MATERIALIZED (SELECT c.k, coalesce(g.m, c.m) AS m FROM c{r} c LEFT JOIN (
  SELECT k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n
    FROM (SELECT a.k AS k, unnest(range(1, 65)) AS i, unnest(q) AS x FROM p{r}) GROUP BY k, i) GROUP BY k) g ON g.k = c.k)"""
ORACLE["op13_clustering"] = (
    r"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, q AS m FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h LIMIT 16)),"""
    + ",".join(_SQL_ROUND.format(r=r, s=r + 1) for r in range(4))
    + r"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM p3 JOIN c3 ON c3.k = a.k"""
)

_KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in licences.SENTENCES.items())
_NAMES = ", ".join(f"CASE WHEN regexp_matches(ids, '{rule}') THEN '{name}' END" for name, rule in sorted(licences.RULES))
ORACLE["op4_license_scan"] = rf"""
WITH c AS (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), '\n+') AS w FROM documents),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS s FROM c),
n AS (SELECT doc_id, i, regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g')), '\.+$', '') AS s FROM u),
k AS (SELECT doc_id, string_agg(coalesce(v.id, '-'), '' ORDER BY i) AS ids FROM n LEFT JOIN (VALUES {_KNOWN}) AS v(s, id) ON n.s = v.s WHERE n.s <> '' GROUP BY doc_id)
SELECT d.doc_id, CAST(length(replace(coalesce(ids, ''), '-', '')) AS BIGINT) AS n_known, coalesce(concat_ws(',', {_NAMES}), '') AS licences
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
