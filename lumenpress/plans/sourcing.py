"""Registered queries of feeds and payloads read as articles, stored tables, events and rules that count phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import text as X
from ..operators import classify as C
from ..scratch import scratch_path
from ..sources import feeds
from . import sqltext as Q
from .registry import query

#: Phrases for the test corpus, whose words are invented: function words of each language stand for subjects and places.
PHRASES = {"north": ["der", "und", "von der", "die"], "west": ["le", "les", "que", "pour"], "south": ["los", "para", "con"], "global": ["the", "with", "of the", "from"]}


def _escaped(c: str):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


# --- feeds and payloads


def _feed_sql(parity: int) -> str:
    clean = lambda c: f"nullif(trim({Q.strip_html(c)}), '')"
    return T.sql(f"SELECT id, {clean('title')} AS title, url, {clean('summary')} AS summary, published_at FROM articles WHERE id % 2 = {parity} AND length({clean('title')}) >= 15", "articles")


def _read_feed(d: DataFrame) -> DataFrame:
    return feeds.feed_items(d, keep=["id"]).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("s03_rss_items", _feed_sql(0))
def s03(spark: SparkSession, sf: str) -> DataFrame:
    """RSS items, here one feed for each article with an even id, read as articles again."""
    a = T.articles(spark, sf).filter("id % 2 = 0")
    date = F.concat(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    xml = F.concat(F.lit("<rss><channel><title>Feed</title><item><title><![CDATA["), "title", F.lit("]]></title><link>"), "url", F.lit("</link><description>"), _escaped("summary"), F.lit("</description><pubDate>"), date, F.lit("</pubDate></item></channel></rss>"))
    return _read_feed(a.select("id", xml.alias("xml")))


@query("s05_atom_entries", _feed_sql(1))
def s05(spark: SparkSession, sf: str) -> DataFrame:
    """Atom entries, here one feed for each article with an odd id, read as articles again."""
    a = T.articles(spark, sf).filter("id % 2 = 1")
    xml = F.concat(F.lit("<feed><entry><title>"), _escaped("title"), F.lit('</title><link rel="alternate" href="'), "url", F.lit('"/><summary>'), _escaped("summary"), F.lit("</summary><updated>"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry></feed>"))
    return _read_feed(a.select("id", xml.alias("xml")))


@query("s06_provider_payloads", T.sql("SELECT CASE id % 2 WHEN 0 THEN 'newsapi' ELSE 'guardian' END AS provider, title, url, CASE id % 2 WHEN 0 THEN summary ELSE title END AS summary, published_at FROM articles", "articles"))
def s06(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of two providers' payloads, here one payload for each article."""
    a = T.articles(spark, sf).withColumn("at", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    first = F.struct(F.array(F.struct("title", "url", F.col("summary").alias("description"), F.col("at").alias("publishedAt"))).alias("articles"))
    second = F.struct(F.struct(F.array(F.struct(F.col("title").alias("webTitle"), F.col("url").alias("webUrl"), F.col("at").alias("webPublicationDate"))).alias("results")).alias("response"))
    read = lambda k, name, body: feeds.provider_articles(a.filter(F.col("id") % 2 == k).select(F.to_json(body).alias("payload")), name).select(F.lit(name).alias("provider"), "*")
    return read(0, "newsapi", first).unionByName(read(1, "guardian", second)).withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("m28_jsonld_items", T.sql("SELECT id, 'WebPage' AS type, NULL::varchar AS headline FROM articles UNION ALL SELECT id, 'NewsArticle', title FROM articles UNION ALL SELECT id, 'Organization', source_name FROM articles", "articles"))
def m28(spark: SparkSession, sf: str) -> DataFrame:
    """Items of JSON-LD: a page, an article of its graph and the graph's main entity."""
    kind = lambda t: F.lit(t).alias("@type")
    graph = F.array(F.struct(kind("NewsArticle"), F.col("title").alias("headline"), F.struct(kind("Organization"), F.col("source_name").alias("headline")).alias("mainEntity")))
    return feeds.jsonld_items(T.articles(spark, sf).select("id", F.to_json(F.struct(kind("WebPage"), graph.alias("@graph"))).alias("jsonld")))


# --- stored tables


@query("k02_json_store", T.sql("SELECT id, title, category_id, published_at FROM articles", "articles"))
def k02(spark: SparkSession, sf: str) -> DataFrame:
    """Articles flushed to a JSON store and scanned again with a stated schema."""
    path = scratch_path(spark, "store")
    T.articles(spark, sf).select("id", "title", "category_id", "published_at").write.mode("overwrite").json(path)
    d = spark.read.schema("id bigint, title string, category_id int, published_at timestamp").json(path)
    return d.withColumn("published_at", F.col("published_at").cast("timestamp_ntz"))


@query("k11_audit_append", "SELECT user_id AS actor, event_type AS action, count(*) AS entries, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """Audit entries appended to one table by two writers, summed by actor and action when read."""
    path = scratch_path(spark, "audit")
    for action in ("signup", "purchase"):
        T.raw(spark, sf, "events").filter(F.col("event_type") == action).select(F.col("user_id").alias("actor"), F.col("event_type").alias("action"), "ts").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("actor", "action").agg(F.count(F.lit(1)).alias("entries"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


# --- events and devices


@query("c31_normal_events", """SELECT 'city-guide_' || substr(sha1('City Guide|' || p_partkey || '|' || p_name || '|2024-02-0' || (p_size % 9 + 1) || 'T20:00:00.000Z|' || p_brand), 1, 12) AS id, p_name AS title,
  CASE p_partkey % 4 WHEN 0 THEN 'Konser' WHEN 1 THEN 'Stand-up' WHEN 2 THEN p_type ELSE p_name END AS category,
  CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE floor(p_retailprice) + 0.5 END::double AS price, p_size % 5 = 0 AS is_free FROM part""")  # fmt: skip
def c31(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events, here made from parts, in normal form: a kind by alias, a price with a decimal comma, free, missing or of two numbers."""
    p = T.raw(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "Rock night").when(F.col("p_partkey") % 4 == 1, "Stand-Up").when(F.col("p_partkey") % 4 == 2, F.col("p_type")).otherwise("")
    amount = F.concat(F.floor("p_retailprice").cast("string"), F.lit(",5 TL"))
    n = F.col("p_size") % 5
    price = F.when(n == 0, "Ücretsiz").when(n == 1, F.lit(None)).when(n == 2, F.lit("10.5 - 20.5")).otherwise(amount)
    start = F.to_timestamp(F.concat(F.lit("2024-02-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit(" 20:00:00")))
    return feeds.normal_events(p.select(F.lit("City Guide").alias("source"), F.col("p_partkey").cast("string").alias("source_id"), kind.alias("kind"), F.col("p_name").alias("title"), start.alias("start"), F.col("p_brand").alias("venue"), price.alias("price")))


@query("m32_devices", "SELECT CASE WHEN user_id % 3 = 2 THEN 'desktop' ELSE 'mobile' END AS device, count(*) AS events, count(DISTINCT user_id) AS readers FROM events GROUP BY 1")
def m32(spark: SparkSession, sf: str) -> DataFrame:
    """Events and readers by kind of device; user agents are made up. Events are counted per reader first."""
    agent = F.element_at(F.array(F.lit("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0)"), F.lit("Mozilla/5.0 (Linux; Android 14)"), F.lit("Mozilla/5.0 (X11; Linux x86_64)")), (F.col("user_id") % 3 + 1).cast("int"))
    per = T.raw(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    device = F.when(agent.rlike("(?i)mobile|android|iphone"), "mobile").otherwise("desktop")
    return per.groupBy(device.alias("device")).agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("readers"))


# --- phrases


def _hits_sql(name: str, weak: tuple[str, ...] = ()) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(t, '{w}') THEN {25 if w in weak else 100} ELSE 0 END" for w in PHRASES[name]) + ")"


def _most_sql(none: str, least: int, weak: tuple[str, ...] = ()) -> str:
    h = {n: _hits_sql(n, weak) for n in PHRASES}
    best = f"greatest({', '.join(h.values())})"
    return T.sql(f"SELECT id, CASE WHEN {best} < {least * 100} THEN '{none}' " + " ".join(f"WHEN {x} = {best} THEN '{n}'" for n, x in h.items()) + f" END AS category FROM (SELECT id, {Q.search_normal('content')} AS t FROM articles)", "articles")


def _content(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).select("id", X.search_normal(F.col("content")).alias("t"))


@query("c07_strict_category", _most_sql("Gündem", 3, ("with", "from")))
def c07(spark: SparkSession, sf: str) -> DataFrame:
    """The category with most phrases, from three hits on, weak phrases a quarter."""
    return _content(spark, sf).select("id", C.most_hits(F.col("t"), PHRASES, "Gündem", 3, frozenset({"with", "from"})).alias("category"))


@query("c08_subcategory", _most_sql(next(iter(PHRASES)), 1))
def c08(spark: SparkSession, sf: str) -> DataFrame:
    """The subcategory with most phrases, ties and none to the first."""
    return _content(spark, sf).select("id", C.most_hits(F.col("t"), PHRASES, next(iter(PHRASES))).alias("category"))


@query("c30_event_category", _most_sql("OTHER", 1))
def c30(spark: SparkSession, sf: str) -> DataFrame:
    """The event category with most keywords, ties by priority, OTHER where none is found."""
    return _content(spark, sf).select("id", C.most_hits(F.col("t"), PHRASES, "OTHER").alias("category"))


_BY_LENGTH = sorted(((w, n) for n, words in PHRASES.items() for w in words), key=lambda p: -len(p[0]))


@query("c26_event_type", T.sql(f"SELECT id, CASE {' '.join(f"WHEN contains(t, '{w}') THEN '{n}'" for w, n in _BY_LENGTH)} ELSE 'UNKNOWN' END AS event_type FROM (SELECT id, {Q.lower_tr('content')} AS t FROM articles)", "articles"))
def c26(spark: SparkSession, sf: str) -> DataFrame:
    """The event type of the longest phrase found."""
    return T.articles(spark, sf).select("id", C.longest_phrase(X.lower_tr(F.col("content")), PHRASES, "UNKNOWN").alias("event_type"))


def _mention_sql(words: list[str]) -> str:
    return " OR ".join(f"regexp_matches(t, '(^|[^a-z0-9_]){w}([^a-z0-9_]|$)')" if len(w) <= 3 else f"contains(t, '{w}')" for w in words)


@query("c27_event_region", T.sql(
    """SELECT id, array_to_string(m, ',') AS regions, coalesce(list_filter(m, lambda r: r <> home AND r <> 'global')[1], m[1], home) AS region
    FROM (SELECT id, CASE language WHEN 'de' THEN 'north' WHEN 'fr' THEN 'west' WHEN 'es' THEN 'south' ELSE 'global' END AS home, list_filter(["""
    + ", ".join(f"CASE WHEN {_mention_sql(words)} THEN '{n}' END" for n, words in PHRASES.items())
    + f"], lambda r: r IS NOT NULL) AS m FROM (SELECT id, language, {Q.lower_tr('content')} AS t FROM articles))", "articles",
))
def c27(spark: SparkSession, sf: str) -> DataFrame:
    """Regions mentioned, and the event's: the first one that isn't the source's own or global, else the first, else its own."""
    home = F.when(F.col("language") == "de", "north").when(F.col("language") == "fr", "west").when(F.col("language") == "es", "south").otherwise("global")
    d = T.articles(spark, sf).select("id", home.alias("home"), X.once(X.lower_tr(F.col("content")), lambda t: C.mentions(t, PHRASES)).alias("m"))
    away = F.filter("m", lambda r: (r != F.col("home")) & (r != "global"))
    return d.select("id", F.array_join("m", ",").alias("regions"), F.coalesce(F.get(away, F.lit(0)), F.get("m", F.lit(0)), "home").alias("region"))


def _region_sql(words: list[str]) -> str:
    end = lambda w: "" if len(w) >= 5 and " " not in w else " "
    return " + ".join(f"CASE WHEN contains(' ' || {f} || ' ', ' {w}{end(w)}') THEN {weight} ELSE 0 END" for f, weight in (("t", 5), ("s", 3), ("c", 1)) for w in words)


@query("c28_region_scores", T.sql(
    "SELECT id, name, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS place FROM (" + " UNION ALL ".join(f"SELECT id, '{n}' AS name, {i} AS i, {_region_sql(words)} AS score FROM n" for i, (n, words) in enumerate(PHRASES.items())) + ") WHERE score > 0",
    "articles", n=f"SELECT id, {Q.search_normal('title')} AS t, {Q.search_normal('summary')} AS s, {Q.search_normal('content')} AS c FROM articles",
))
def c28(spark: SparkSession, sf: str) -> DataFrame:
    """Regions by weighted keywords: title 5, summary 3, content 1; ties in the table's order."""
    fields = [(F.col(k), w) for k, w in (("t", 5), ("s", 3), ("c", 1))]
    n = T.articles(spark, sf).select("id", *(X.search_normal(F.col(c)).alias(k) for k, c in (("t", "title"), ("s", "summary"), ("c", "content"))))
    d = n.select("id", F.posexplode(C.region_scores(fields, PHRASES)).alias("p", "r"))
    return d.select("id", "r.name", "r.score", (F.col("p") + 1).alias("place"))


@query("c34_topic_words", T.sql(f"SELECT w AS label, count(*) AS weight FROM (SELECT unnest(string_split({Q.vector_normal('content')}, ' ')) AS w FROM articles) WHERE length(w) > 2 AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {Q.q(X.SEARCH_STOP)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "articles"))
def c34(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent words as topics, where no topic model is at hand."""
    w = T.articles(spark, sf).select(F.explode(F.split(X.vector_normal(F.col("content")), " ")).alias("label"))
    w = w.filter((F.length("label") > 2) & ~F.col("label").rlike("^[0-9]+$") & ~F.col("label").isin(X.SEARCH_STOP))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "label").limit(20)


@query("c19_light_language", T.sql(
    f"""SELECT id, CASE WHEN n = '' THEN 'unknown' WHEN m * 2 + len(list_filter(w, lambda x: x IN {Q.q(C.LIGHT_TR)})) >= 2 THEN 'tr' WHEN len(list_filter(w, lambda x: x IN {Q.q(C.LIGHT_EN)})) >= 2 OR (len(w) >= 8 AND m = 0) THEN 'en' ELSE 'unknown' END AS language
    FROM (SELECT id, n, m, string_split(n, ' ') AS w FROM (SELECT id, {Q.dedupe_normal('summary')} AS n, length(regexp_replace(summary, '[^çğıİöşüÇĞÖŞÜ]', '', 'g')) AS m FROM articles))""", "articles",
))
def c19(spark: SparkSession, sf: str) -> DataFrame:
    """The language of summaries by marked letters and hint words."""
    return T.articles(spark, sf).select("id", C.light_language(F.col("summary")).alias("language"))


@query("t30_distinct_bullets")
def t30(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of summaries as bullets, without those that say the same."""
    d = T.articles(spark, sf).select("id", X.distinct_bullets(F.split("summary", "(?<=[.!?])\\s+")).alias("bullets"))
    return d.select("id", F.posexplode("bullets").alias("place", "bullet"))


@query("f19_old_reports", T.sql("SELECT DISTINCT category_id FROM articles", "articles"))
def f19(spark: SparkSession, sf: str) -> DataFrame:
    """Of reports stored by category those over 30 days old, seen from 31 days after they were written."""
    path = scratch_path(spark, "reports")
    T.articles(spark, sf).groupBy("category_id").agg(F.count(F.lit(1)).alias("articles")).write.partitionBy("category_id").mode("overwrite").parquet(path)
    old = feeds.old_files(spark, path, F.current_timestamp() + F.expr("INTERVAL 31 DAYS") - F.expr("INTERVAL 30 DAYS"))
    return old.select(F.regexp_extract("path", r"category_id=(\d+)", 1).cast("int").alias("category_id")).distinct()
