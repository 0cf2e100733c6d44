"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, media, mixing, neardup, negatives, packing, passages, quality, ranked, secrets, sharding, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC bundles and read back."""
    back = warc.archive(_table(spark, sf_dir, "pages"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT DISTINCT hex, array_to_string(list_transform(range(40), lambda i: right(format('{:b}', 16 + cast('0x' || hex[i + 1] AS int)), 4)), '') AS b FROM p
), named AS (
  SELECT hex, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast(
    16 * cast(b[5 * i + 1] AS int) + 8 * cast(b[5 * i + 2] AS int) + 4 * cast(b[5 * i + 3] AS int) + 2 * cast(b[5 * i + 4] AS int) + cast(b[5 * i + 5] AS int) AS int) + 1]), '') AS digest FROM bits
), firsts AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, cast(strlen(html) AS bigint) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN firsts USING (hex) JOIN named USING (hex)
"""


def op2_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents."""
    return quality.robust_outliers(_table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("d2")


def op3_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.main_text(_table(spark, sf_dir, "pages"), carry=["page_id", "url"])


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of all documents: the least doc_id of the class."""
    return neardup.near_classes(_table(spark, sf_dir, "documents"), carry=["doc_id"])


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op5_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages' urls."""
    # as SQL, so that no Python worker makes these two tables
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES) + " AS t(verdict, host, path)")
    listed = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}')" for h in LISTED_HOSTS) + " AS t(host)")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, rules, listed).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), judged AS (
  SELECT *,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN regexp_matches(host, '^(.*\\.)?(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$') THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
"""


def op6_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as chunked 8-bit media and read back."""
    return media.media_column(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op7_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, near equal in bytes, equal texts together."""
    d = sharding.shard(_table(spark, sf_dir, "documents"), 8, carry=["doc_id"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes from each."""
    return mixing.mix(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    d = secrets.find_secrets(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_sort(F.concat("base", "added"))
    return d.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(spans).alias("spans"))


def op11_sorted_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all documents for each benchmark item."""
    return ranked.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), carry=["item_id"]).select("item_id", "rank", F.col("key").alias("doc_id"), "score")


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents
), q AS (
  SELECT item_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS total, cast(sum(len(terms)) AS bigint) AS words FROM d),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, cast(len(terms) AS bigint) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, cast(floor(1000 * ln(cast(2 * any_value(total) + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS w FROM post, corpus GROUP BY term),
scored AS (
  SELECT item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * total) // words)))) AS bigint) AS score
  FROM post JOIN weights USING (term) JOIN asked USING (term), corpus GROUP BY item_id, doc_id
), placed AS (SELECT *, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS int) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""


def op12_centroid_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, sf_dir, "embeddings"), label=label)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, cast(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS bigint) AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, cast(list_inner_product(a.q, b.q) AS bigint) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), placed AS (
  SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS int) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM placed WHERE rank <= 10
"""


def op13_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words or more that start earlier."""
    return passages.repeats(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
windows AS (SELECT doc_id, p, array_to_string(list_slice(words, p, p + 19), ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM d)),
later AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS again FROM windows),
gone AS (
  SELECT doc_id, p, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS removed
  FROM placed LEFT JOIN later USING (doc_id, p)
), kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS text FROM gone GROUP BY doc_id)
SELECT doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_bundles": op1_warc_bundles,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_consensus_paths": op3_consensus_paths,
    "op4_bag_minhash": op4_bag_minhash,
    "op5_url_cascade": op5_url_cascade,
    "op6_chunked_media": op6_chunked_media,
    "op7_vector_best_fit": op7_vector_best_fit,
    "op8_lpt_shards": op8_lpt_shards,
    "op10_randomness_battery": op10_randomness_battery,
    "op9_water_filling": op9_water_filling,
    "op11_sorted_accumulation": op11_sorted_accumulation,
    "op12_centroid_radii": op12_centroid_radii,
    "op13_level_doubling": op13_level_doubling,
}
ORACLE: dict[str, str] = {"op1_warc_bundles": OP1_SQL, "op5_url_cascade": OP5_SQL, "op11_sorted_accumulation": OP11_SQL, "op12_centroid_radii": OP12_SQL, "op13_level_doubling": OP13_SQL}
