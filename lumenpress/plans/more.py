"""Registered queries of joins, pages, text rules, scores and recommendation steps that stand for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scoring as S
from ..functions import text as X
from ..operators import relational as R
from ..operators import search as V
from . import sqltext as Q
from .content import _HOURS, ladder_sql
from .registry import query
from .search import _INDEX, _PAIR_CTES, _TERMS, _bm25_sql, _indexed, _title_pairs

_NOW = f"TIMESTAMP '{T.AS_OF}'"


# --- joins


@query("j02_category_articles", T.sql("SELECT a.id, c.category_id, c.confidence FROM articles a JOIN article_categories c ON c.article_id = a.id WHERE c.confidence >= 0.7", "articles", "article_categories"))
def j02(spark: SparkSession, sf: str) -> DataFrame:
    c = T.article_categories(spark, sf).filter("confidence >= 0.7").select(F.col("article_id").alias("id"), "category_id", "confidence")
    return T.articles(spark, sf).select("id").join(c, "id")


@query("j03_bookmarked", T.sql("SELECT id, title FROM articles WHERE id IN (SELECT article_id FROM bookmarks)", "articles", "bookmarks"))
def j03(spark: SparkSession, sf: str) -> DataFrame:
    b = T.bookmarks(spark, sf).select(F.col("article_id").alias("id"))
    return T.articles(spark, sf).join(b, "id", "left_semi").select("id", "title")


@query(
    "j06_source_metrics",
    T.sql(
        """SELECT s.id, coalesce(n, 0) AS articles, coalesce(v, 0) AS views, coalesce(e, 0) AS events, coalesce(u, 0) AS readers FROM sources s
        LEFT JOIN (SELECT source_id, count(*) AS n, sum(view_count) AS v FROM articles GROUP BY 1) m ON m.source_id = s.id
        LEFT JOIN (SELECT source_id, sum(c) AS e, count(DISTINCT user_id) AS u FROM (SELECT source_id, user_id, count(*) AS c FROM user_events x JOIN articles a ON a.id = x.article_id GROUP BY 1, 2) GROUP BY 1) k ON k.source_id = s.id""",
        "sources",
        "articles",
        "user_events",
    ),
)
def j06(spark: SparkSession, sf: str) -> DataFrame:
    """Two aggregates, of articles and of their events, joined to sources; events are counted per user before the join."""
    a = T.articles(spark, sf)
    own = a.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("articles"), F.sum("view_count").alias("views"))
    e = T.user_events(spark, sf).groupBy("article_id", "user_id").agg(F.count(F.lit(1)).alias("c")).join(a.select(F.col("id").alias("article_id"), "source_id"), "article_id")
    e = e.groupBy("source_id", "user_id").agg(F.sum("c").alias("c")).groupBy(F.col("source_id").alias("id")).agg(F.sum("c").alias("events"), F.count(F.lit(1)).alias("readers"))
    d = T.sources(spark, sf).select("id").join(own, "id", "left").join(e, "id", "left")
    return d.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "views", "events", "readers")))


@query("j12_interest_names", T.sql("SELECT user_id, w.category_id, coalesce(c.name, 'unknown') AS name, events FROM (SELECT user_id, cast(article_id % 12 AS int) AS category_id, count(*) AS events FROM user_events GROUP BY 1, 2) w LEFT JOIN categories c ON c.id = w.category_id", "user_events", "categories"))
def j12(spark: SparkSession, sf: str) -> DataFrame:
    """Interests with their category's name, where the category still exists."""
    w = T.user_events(spark, sf).groupBy("user_id", (F.col("article_id") % 12).cast("int").alias("category_id")).agg(F.count(F.lit(1)).alias("events"))
    c = T.categories(spark).withColumnRenamed("id", "category_id")
    return w.join(F.broadcast(c), "category_id", "left").select("user_id", "category_id", F.coalesce("name", F.lit("unknown")).alias("name"), "events")


@query("j21_time_band", T.sql("SELECT p.a, p.b FROM p JOIN articles x ON x.id = p.a JOIN articles y ON y.id = p.b WHERE abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= 86400000000", "articles", **_PAIR_CTES))
def j21(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of alike titles published within a day of each other."""
    a = T.articles(spark, sf)
    side = lambda c: a.select(F.col("id").alias(c), F.col("published_at").alias(f"at_{c}"))
    d = _title_pairs(spark, sf).select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return d.filter(F.abs(F.unix_micros("at_a") - F.unix_micros("at_b")) <= 86_400_000_000).select("a", "b")


# --- places and pages


@query("w01_places", T.sql("SELECT id, view_count, row_number() OVER (ORDER BY view_count DESC, id) AS rank FROM articles", "articles"))
def w01(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranked(T.articles(spark, sf).select("id", "view_count"), "view_count")


@query("w02_page_places", T.sql("SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS place FROM articles QUALIFY place BETWEEN 41 AND 60", "articles"))
def w02(spark: SparkSession, sf: str) -> DataFrame:
    """The third page of twenty with places in the whole list."""
    d = R.page(T.articles(spark, sf).orderBy(F.desc("published_at"), "id"), 3, 20)
    return d.select("id", (40 + F.row_number().over(Window.orderBy(F.desc("published_at"), "id"))).cast("long").alias("place"))


@query("o02_popular_first", T.sql("SELECT id, view_count, published_at FROM articles WHERE language = 'en' ORDER BY view_count DESC, published_at DESC, id LIMIT 50", "articles"))
def o02(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).filter("language = 'en'").orderBy(F.desc("view_count"), F.desc("published_at"), "id").limit(50).select("id", "view_count", "published_at")


@query("o03_search_order", T.sql(f"SELECT s.id, s.score, round(a.view_count * exp(-0.05 * {_HOURS}), 6) AS trend FROM ({_bm25_sql()[0]}) s JOIN articles a ON a.id = s.id ORDER BY trend DESC, s.id LIMIT 20", "articles", x=_INDEX, t=_bm25_sql()[1]))
def o03(spark: SparkSession, sf: str) -> DataFrame:
    """Matches of a search by decayed views instead of BM25."""
    a = T.articles(spark, sf).select("id", F.round(S.decayed_views(F.col("view_count"), F.col("published_at"), T.as_of()), 6).alias("trend"))
    return V.bm25(_indexed(spark, sf), _TERMS).join(a, "id").orderBy(F.desc("trend"), "id").limit(20)


@query("o05_event_page", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 24 OFFSET 24")
def o05(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of events, 24 each, with the number of all."""
    d = T.raw(spark, sf, "orders")
    total = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    return R.page(d.orderBy("o_orderdate", "o_orderkey"), 2, 24).select("o_orderkey", "o_orderdate", total.alias("total"))


@query("o07_label_order", T.sql("SELECT id, matches, best FROM (SELECT article_id, count(*) AS matches, max(confidence) AS best FROM article_categories WHERE category_id IN (0, 2, 5) GROUP BY 1) JOIN articles ON id = article_id ORDER BY matches DESC, cast(round(best * 100) AS int) DESC, published_at DESC, id LIMIT 30", "articles", "article_categories"))
def o07(spark: SparkSession, sf: str) -> DataFrame:
    """Articles by the number of wanted labels, best score in hundredths, time."""
    c = T.article_categories(spark, sf).filter("category_id in (0, 2, 5)").groupBy(F.col("article_id").alias("id")).agg(F.count(F.lit(1)).alias("matches"), F.max("confidence").alias("best"))
    d = c.join(T.articles(spark, sf).select("id", "published_at"), "id")
    return d.orderBy(F.desc("matches"), F.desc(F.round(F.col("best") * 100).cast("int")), F.desc("published_at"), "id").limit(30).select("id", "matches", "best")


@query("o13_ready_recommendations", T.sql("SELECT user_id, article_id, first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first, article_id) AS n FROM (SELECT user_id, article_id, min(created_at) AS first FROM user_events GROUP BY 1, 2)) WHERE n <= 10", "user_events"))
def o13(spark: SparkSession, sf: str) -> DataFrame:
    """Per reader ten stored recommendations, each article once."""
    d = T.user_events(spark, sf).groupBy("user_id", "article_id").agg(F.min("created_at").alias("first"))
    return R.top_per_group(d, ["user_id"], [F.col("first"), F.col("article_id")], 10).drop("rank")


# --- text rules


def _each(spark: SparkSession, sf: str, **columns) -> DataFrame:
    return T.articles(spark, sf).select("id", *(c.alias(k) for k, c in columns.items()))


@query("t04_title_normal", T.sql(f"SELECT id, {Q.title_normal('title')} AS normal FROM articles", "articles"))
def t04(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, normal=X.title_normal(F.col("title")))


_MARKERS = "|".join(X.TITLE_OPENINGS)


@query("t05_title_without_markers", T.sql(f"SELECT id, trim(regexp_replace(regexp_replace(' ' || {Q.dedupe_normal('title')} || ' ', ' ({_MARKERS}) ', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM articles", "articles"))
def t05(spark: SparkSession, sf: str) -> DataFrame:
    """Titles without markers wherever they stand."""
    t = F.regexp_replace(F.concat(F.lit(" "), X.dedupe_normal(F.col("title")), F.lit(" ")), f" ({_MARKERS}) ", " ")
    return _each(spark, sf, normal=F.trim(F.regexp_replace(t, " +", " ")))


@query("t09_simple_urls", f"SELECT page_id, {Q.simple_url('url')} AS url FROM pages")
def t09(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "pages").select("page_id", X.simple_url(F.col("url")).alias("url"))


@query("t10_article_urls", T.sql(f"SELECT id, {Q.canonical_url('url')} AS url FROM articles", "articles"))
def t10(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, url=X.canonical_url(F.col("url")))


@query("t13_content_hashes", T.sql(f"SELECT id, sha256({Q.title_normal('title')} || chr(10) || {Q.dedupe_normal('content')}) AS exact_hash, sha256({Q.dedupe_normal('content')}) AS content_hash FROM articles", "articles"))
def t13(spark: SparkSession, sf: str) -> DataFrame:
    content = X.dedupe_normal(F.col("content"))
    return _each(spark, sf, exact_hash=F.sha2(F.concat(X.title_normal(F.col("title")), F.lit("\n"), content), 256), content_hash=F.sha2(content, 256))


@query("t15_decoded_pages", f"SELECT page_id, sha256({Q.decode_entities('html')}) AS decoded FROM pages")
def t15(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "pages").select("page_id", F.sha2(X.decode_entities(F.col("html")), 256).alias("decoded"))


@query("t25_short_titles", T.sql("SELECT id, CASE WHEN length(title) <= 40 THEN title ELSE rtrim(substr(title, 1, 39)) || '…' END AS short FROM articles", "articles"))
def t25(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, short=X.shorten(F.col("title"), 40))


@query("t27_keyword_hits", T.sql(f"SELECT id, contains(' ' || n || ' ', ' the ') AS word, contains(n, 'of the') AS phrase FROM (SELECT id, {Q.dedupe_normal('content')} AS n FROM articles)", "articles"))
def t27(spark: SparkSession, sf: str) -> DataFrame:
    """A single word only whole, a phrase anywhere."""
    n = X.dedupe_normal(F.col("content"))
    return _each(spark, sf, word=X.keyword_hit(n, "the"), phrase=X.keyword_hit(n, "of the"))


@query("t28_region_hits", T.sql(f"SELECT id, len(list_filter(w, lambda x: x = 'der')) > 0 AS short, len(list_filter(w, lambda x: starts_with(x, 'ation'))) > 0 AS long FROM (SELECT id, string_split({Q.dedupe_normal('content')}, ' ') AS w FROM articles)", "articles"))
def t28(spark: SparkSession, sf: str) -> DataFrame:
    """A keyword under five letters as a whole word, a longer one also as a word's beginning."""
    hit = lambda k: F.exists(F.split(X.dedupe_normal(F.col("content")), " "), lambda w: w.startswith(k) if len(k) >= 5 else w == k)
    return _each(spark, sf, short=hit("der"), long=hit("ation"))


# --- scores


@query("m02_recommendation_freshness", T.sql(f"SELECT id, {ladder_sql('recommendation')} AS freshness FROM articles", "articles"))
def m02(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, freshness=S.freshness(F.col("published_at"), T.as_of(), "recommendation"))


@query("m03_feed_recency", T.sql(f"SELECT id, {ladder_sql('feed')} AS recency FROM articles", "articles"))
def m03(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, recency=S.freshness(F.col("published_at"), T.as_of(), "feed"))


@query("m05_recency", T.sql(f"SELECT id, round(CASE WHEN published_at IS NULL THEN 0.5 ELSE exp(-0.05 * {_HOURS}) END, 6) AS recency FROM (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE published_at END AS published_at FROM articles)", "articles"))
def m05(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential recency; every seventh article is undated."""
    return _each(spark, sf, recency=F.round(S.recency(F.when(F.col("id") % 7 != 0, F.col("published_at")), T.as_of()), 6))


@query("m06_hyperbolic_decay", T.sql(f"SELECT id, round(1 / (1 + 0.05 * {_HOURS} / 24), 6) AS decay FROM articles", "articles"))
def m06(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, decay=F.round(1 / (1 + 0.05 * S.hours_old(F.col("published_at"), T.as_of()) / 24), 6))


@query("m13_clamped", "SELECT event_id, greatest(0, least(1, value / 10)) AS unit, greatest(0, least(100, value)) AS percent FROM events")
def m13(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return T.raw(spark, sf, "events").select("event_id", S.clamp01(v / 10).alias("unit"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)).alias("percent"))


@query("m15_event_quality", "SELECT p_partkey, round(20 + CASE WHEN length(p_name) > 12 THEN 10 ELSE 0 END + CASE WHEN p_retailprice IS NOT NULL THEN 8 ELSE 0 END + (p_partkey % 100) * 0.6::double + (p_size % 50) * 0.4::double, 6) AS quality FROM part")
def m15(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of events (parts stand for them): image 20, description 10, price 8, .6 trust, .4 popularity."""
    q = 20 + F.when(F.length("p_name") > 12, 10).otherwise(0) + F.when(F.col("p_retailprice").isNotNull(), 8).otherwise(0) + F.col("p_partkey") % 100 * 0.6 + F.col("p_size") % 50 * 0.4
    return T.raw(spark, sf, "part").select("p_partkey", F.round(q, 6).alias("quality"))


_HERO = f"CASE WHEN category_id = 0 THEN 100 ELSE 0 END + CASE WHEN share_count >= 80 THEN 80 ELSE 0 END + CASE WHEN {_HOURS} <= 2 THEN 50 WHEN {_HOURS} <= 6 THEN 30 WHEN {_HOURS} <= 24 THEN 10 ELSE 0 END + least(20, (view_count % 101) / 5) + least(20, (id % 101) / 5) + least(10, share_count / 10)"


@query("m16_hero_score", T.sql(f"SELECT id, round({_HERO}, 6) AS score FROM articles", "articles"))
def m16(spark: SparkSession, sf: str) -> DataFrame:
    """Breaking 100, critical 80, age 50, 30 or 10, a fifth of trend and relevance up to 20 each, importance up to 10."""
    h = S.hours_old(F.col("published_at"), T.as_of())
    age = F.when(h <= 2, 50).when(h <= 6, 30).when(h <= 24, 10).otherwise(0)
    s = F.when(F.col("category_id") == 0, 100).otherwise(0) + F.when(F.col("share_count") >= 80, 80).otherwise(0) + age
    s = s + F.least(F.lit(20.0), F.col("view_count") % 101 / 5) + F.least(F.lit(20.0), F.col("id") % 101 / 5) + F.least(F.lit(10.0), F.col("share_count") / 10)
    return _each(spark, sf, score=F.round(s, 6))


@query("m17_importance", T.sql("SELECT id, round(least(0.99::double, 0.35::double + least(0.25::double, (id % 12) * 0.03::double) + least(0.2::double, (view_count % 15) * 0.02::double) + CASE WHEN id % 3 = 0 THEN 0.12::double ELSE 0 END), 6) AS importance FROM articles", "articles"))
def m17(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, importance=F.round(S.importance(F.col("id") % 12, F.col("view_count") % 15, F.col("id") % 3 == 0), 6))


@query("m19_remind_at", f"SELECT o_orderkey, greatest(cast(o_orderdate AS timestamp) - INTERVAL 24 HOURS, {_NOW}) AS remind_at FROM orders")
def m19(spark: SparkSession, sf: str) -> DataFrame:
    """A day before the event, but not in the past."""
    return T.raw(spark, sf, "orders").select("o_orderkey", F.greatest(F.col("o_orderdate").cast("timestamp") - F.expr("INTERVAL 24 HOURS"), T.as_of()).alias("remind_at"))


@query("m25_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(-40, least(40, value - 10)))), 9) AS p FROM events")
def m25(spark: SparkSession, sf: str) -> DataFrame:
    return T.raw(spark, sf, "events").select("event_id", F.round(S.sigmoid(F.col("value") - 10), 9).alias("p"))


# --- search


@query("v07_keyword_search", T.sql(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ({_bm25_sql()[0]}) ORDER BY rank LIMIT 50", "articles", x=_INDEX, t=_bm25_sql()[1]))
def v07(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty best matches with their places."""
    d = V.bm25(_indexed(spark, sf), _TERMS).orderBy(F.desc("score"), "id").limit(50)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query("v16_overlaps", T.sql("SELECT a, b, round(s / greatest(4, m), 6) AS least4, round(s / greatest(2, m), 6) AS least2, round(s / greatest(6, m), 6) AS least6, round(s / most, 6) AS largest FROM (SELECT a, b, len(list_intersect(ta, tb)) AS s, least(len(ta), len(tb)) AS m, greatest(len(ta), len(tb)) AS most FROM p)", "articles", **_PAIR_CTES))
def v16(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap coefficients of alike titles with different least sizes, and over the larger set."""
    a, b = F.col("ta"), F.col("tb")
    largest = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))
    return _title_pairs(spark, sf).select("a", "b", *(F.round(V.overlap(a, b, k), 6).alias(f"least{k}") for k in (4, 2, 6)), F.round(largest, 6).alias("largest"))


_SUGGEST = f"""SELECT value, sum(w) AS weight FROM (
  SELECT title AS value, 2.0::double AS w FROM articles UNION ALL SELECT name, 2.5 FROM articles a JOIN categories c ON c.id = a.category_id UNION ALL SELECT source_name, 1.5 FROM articles)
  WHERE value <> '' AND length(value) <= 80 AND contains({Q.search_normal('value')}, 'sr') GROUP BY 1"""


@query("v03_suggestions", T.sql(f"SELECT value, weight FROM ({_SUGGEST}) ORDER BY weight DESC, value LIMIT 8", "articles", "categories"))
def v03(spark: SparkSession, sf: str) -> DataFrame:
    """Suggestions for a beginning of a query: titles 2, labels 2.5, sources 1.5, summed per value; the eight best."""
    a = T.articles(spark, sf)
    labels = a.groupBy("category_id").agg(F.count(F.lit(1)).alias("n")).join(T.categories(spark).withColumnRenamed("id", "category_id"), "category_id")
    pools = [(a.groupBy(F.col("title").alias("value")).agg(F.count(F.lit(1)).alias("n")), 2.0), (labels.select(F.col("name").alias("value"), "n"), 2.5), (a.groupBy(F.col("source_name").alias("value")).agg(F.count(F.lit(1)).alias("n")), 1.5)]
    d = None
    for p, w in pools:
        p = p.select("value", (F.col("n") * w).alias("w"))
        d = p if d is None else d.unionByName(p)
    d = d.filter((F.col("value") != "") & (F.length("value") <= 80) & X.search_normal(F.col("value")).contains("sr"))
    return d.groupBy("value").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "value").limit(8)


# --- recommendation and governance


@query("r02_trend_list", T.sql(f"SELECT id, round(view_count * exp(-0.05 * {_HOURS}), 6) AS score FROM articles WHERE category_id = 2 AND NOT is_duplicate ORDER BY score DESC, id LIMIT 20", "articles"))
def r02(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).filter("category_id = 2 and not is_duplicate")
    return d.select("id", F.round(S.decayed_views(F.col("view_count"), F.col("published_at"), T.as_of()), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


_WEIGHTS = f"SELECT user_id, category_id, sum({T.TENTHS_SQL}) AS w FROM user_events e JOIN article_categories c ON c.article_id = e.article_id GROUP BY 1, 2"


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, category_id, w): summed event weights in tenths. Events are counted per article before the join."""
    e = T.user_events(spark, sf).groupBy("user_id", "article_id").agg(F.sum(T.tenths()).alias("w"))
    return e.join(T.article_categories(spark, sf).select("article_id", "category_id"), "article_id").groupBy("user_id", "category_id").agg(F.sum("w").alias("w"))


@query("r07_profile_vector", T.sql("SELECT user_id, category_id, round(w / sum(w) OVER (PARTITION BY user_id), 6) AS share FROM w WHERE w > 0", "user_events", "article_categories", w=_WEIGHTS))
def r07(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's category vector: weights over their sum."""
    d = _profile(spark, sf).filter("w > 0")
    return d.select("user_id", "category_id", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("user_id")), 6).alias("share"))


_COLD = """SELECT a.id, max(round(0.55::double * (category_id_w / 9) + 0.20::double * confidence + 0.15::double * view_count / 997 + 0.10::double * trust_score, 6)) AS score
  FROM articles a JOIN (SELECT article_id, category_id AS category_id_w, confidence FROM article_categories) c ON c.article_id = a.id JOIN sources s ON s.id = a.source_id WHERE category_id_w >= 5 GROUP BY 1"""


@query("r21_cold_start_interests", T.sql(f"SELECT id, score FROM ({_COLD}) ORDER BY score DESC, id LIMIT 50", "articles", "article_categories", "sources"))
def r21(spark: SparkSession, sf: str) -> DataFrame:
    """For a reader with stated interests (weight of a category: its id over nine): .55 interest, .20 confidence, .15 views, .10 trust."""
    c = T.article_categories(spark, sf).filter("category_id >= 5").select(F.col("article_id").alias("id"), F.col("category_id").alias("c"), "confidence")
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    d = T.articles(spark, sf).select("id", "source_id", "view_count").join(c, "id").join(F.broadcast(s), "source_id")
    score = 0.55 * (F.col("c") / 9) + 0.20 * F.col("confidence") + 0.15 * F.col("view_count") / 997 + 0.10 * F.col("trust_score")
    return d.groupBy("id").agg(F.max(F.round(score, 6)).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("g09_permission_closure", "SELECT c_custkey AS user_id, list(DISTINCT n_name ORDER BY n_name) AS permissions FROM customer JOIN nation g ON g.n_regionkey = c_nationkey % 5 GROUP BY 1")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    """A user's permissions through the role (regions and nations stand for roles and permissions); permissions of a role are few."""
    roles = T.raw(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_set("n_name")).alias("permissions"))
    d = T.raw(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).alias("role"))
    return d.join(F.broadcast(roles), F.col("role") == F.col("n_regionkey")).select("user_id", "permissions")


@query("f25_saved_searches", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND conv_id % 3 = 0 ORDER BY conv_id DESC, turn DESC LIMIT 40")
def f25(spark: SparkSession, sf: str) -> DataFrame:
    """Saved searches (user turns stand for them), newest first."""
    return T.raw(spark, sf, "conversations").filter("role = 'user' and conv_id % 3 = 0").orderBy(F.desc("conv_id"), F.desc("turn")).limit(40).select("conv_id", "turn", "text")


@query("c35_trust_labels", T.sql("SELECT id, CASE WHEN trust_score >= 0.8 THEN 'high' WHEN trust_score >= 0.5 THEN 'medium' ELSE 'low' END AS badge FROM sources", "sources"))
def c35(spark: SparkSession, sf: str) -> DataFrame:
    return T.sources(spark, sf).select("id", X.trust_badge(F.col("trust_score")).alias("badge"))
