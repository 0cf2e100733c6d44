"""Registered queries of alike stories, stems, arbitration between classifiers, reader scores, catalogs and reminders."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scoring as S
from ..functions import text as X
from ..operators import classify as C
from ..operators import graph as G
from ..operators import search as V
from ..sources import feeds
from . import sqltext as Q
from .content import ladder_sql
from .extra import _STORY, _stories
from .more import _WEIGHTS, _each, _profile
from .registry import ORACLE, query
from .search import _LONG, _PAIR_CTES, _REACH, CORPUS_RULES, _exact_links, _normal, _title_pairs, _titles

_NOW = f"TIMESTAMP '{T.AS_OF}'"


def _sided(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Pairs of alike titles with columns of both articles, as name_a and name_b."""
    a = T.articles(spark, sf)
    side = lambda c: a.select(F.col("id").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in columns))
    return _title_pairs(spark, sf).join(side("a"), "a").join(side("b"), "b")


_BOTH = "p JOIN articles x ON x.id = p.a JOIN articles y ON y.id = p.b"
_GAP = "(abs(epoch_us(x.published_at) - epoch_us(y.published_at)) / 3600e6)"
_JACCARD = "(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))))"


def _gap():
    return F.abs(F.unix_micros("published_at_a") - F.unix_micros("published_at_b")) / 3600e6


# --- pairs of titles


@query("j20_story_pairs", T.sql("SELECT a, b, score FROM st WHERE score >= 0.68", "articles", **_PAIR_CTES, st=_STORY))
def j20(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the same story: at most a day apart with a story score from 0.68 on."""
    return _stories(spark, sf).filter("score >= 0.68")


def _closeness_sql(name: str) -> str:
    steps, far, missing = S.CLOSENESS[name]
    return f"(CASE WHEN {_GAP} IS NULL THEN {missing}::double " + " ".join(f"WHEN {_GAP} <= {h} THEN {s}::double" for h, s in steps) + f" ELSE {far}::double END)"


@query("m07_closeness", T.sql(f"SELECT a, b, {', '.join(f'{_closeness_sql(k)} AS {k}' for k in S.CLOSENESS)} FROM {_BOTH}", "articles", **_PAIR_CTES))
def m07(spark: SparkSession, sf: str) -> DataFrame:
    """How close in time alike titles are, by three ladders."""
    return _sided(spark, sf, "published_at").select("a", "b", *(S.closeness(_gap(), k).alias(k) for k in S.CLOSENESS))


@query("v08_pair_bm25", T.sql(
    """SELECT p.a, p.b, round(least(1, coalesce(shared, 0) / 2 / greatest(oa.own, ob.own, 0.001)), 6) AS score FROM p
    LEFT JOIN (SELECT p.a, p.b, sum(x.w + y.w) AS shared FROM p JOIN tw x ON x.id = p.a JOIN tw y ON y.id = p.b AND y.token = x.token GROUP BY 1, 2) s ON s.a = p.a AND s.b = p.b
    JOIN (SELECT id, sum(w) AS own FROM tw GROUP BY 1) oa ON oa.id = p.a JOIN (SELECT id, sum(w) AS own FROM tw GROUP BY 1) ob ON ob.id = p.b""",
    "articles", **_PAIR_CTES,
    tf="SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM every) GROUP BY 1, 2",
    tw="""SELECT id, token, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / greatest(mean, 1))) AS w
      FROM tf JOIN (SELECT token, count(*) AS df FROM tf GROUP BY 1) USING (token) JOIN (SELECT id, len(t) AS len FROM every) USING (id), (SELECT count(*) AS n, avg(len(t)) AS mean FROM every WHERE len(t) > 0)""",
))
def v08(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of titles for each other's terms, over the larger one for its own."""
    d = T.articles(spark, sf).select("id", X.dedupe_tokens(F.col("title")).alias("tokens"))
    return V.pair_bm25(d, _title_pairs(spark, sf))


@query("v25_event_similarity", T.sql(f"""SELECT a, b, round({_JACCARD} * 0.45::double + CASE WHEN x.category_id = y.category_id THEN 0.15::double ELSE 0 END + CASE WHEN x.language = y.language THEN 0.10::double ELSE 0 END
  + CASE WHEN x.source_name = y.source_name THEN 0.15::double ELSE 0 END + CASE WHEN {_GAP} <= 48 THEN 0.15::double ELSE 0 END, 6) AS score FROM {_BOTH}""", "articles", **_PAIR_CTES))  # fmt: skip
def v25(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of events; language stands for the city and the source for the venue."""
    same = lambda c, w: F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), w).otherwise(0.0)
    score = V.jaccard(F.col("ta"), F.col("tb")) * 0.45 + same("category_id", 0.15) + same("language", 0.10) + same("source_name", 0.15) + F.when(_gap() <= 48, 0.15).otherwise(0.0)
    return _sided(spark, sf, "category_id", "language", "source_name", "published_at").select("a", "b", F.round(score, 6).alias("score"))


_HINTS = " + ".join(f"CASE WHEN contains(sa || ' ' || sb, '{h}') THEN 1 ELSE 0 END" for h in X.FINANCE_HINTS)


@query("v27_title_similarity", T.sql(f"""SELECT a, b, round(CASE WHEN sa = '' OR sb = '' THEN j WHEN sa = sb THEN 1 WHEN contains(sa, sb) OR contains(sb, sa) THEN greatest(j, 0.82::double) WHEN {_HINTS} >= 3 THEN greatest(j, 0.78::double) ELSE j END, 6) AS score
  FROM (SELECT a, b, {Q.story_title("x.title")} AS sa, {Q.story_title("y.title")} AS sb, {_JACCARD} AS j FROM {_BOTH})""", "articles", **_PAIR_CTES))  # fmt: skip
def v27(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of titles with floors: one contains the other .82, both on interest rates .78."""
    d = _sided(spark, sf, "title").select("a", "b", V.jaccard(F.col("ta"), F.col("tb")).alias("j"), X.story_title(F.col("title_a")).alias("sa"), X.story_title(F.col("title_b")).alias("sb"))
    sa, sb, j = F.col("sa"), F.col("sb"), F.col("j")
    hints = sum((F.concat_ws(" ", sa, sb).contains(h).cast("int") for h in X.FINANCE_HINTS), F.lit(0))
    s = F.when((sa == "") | (sb == ""), j).when(sa == sb, 1.0).when(sa.contains(sb) | sb.contains(sa), F.greatest(j, F.lit(0.82))).when(hints >= 3, F.greatest(j, F.lit(0.78))).otherwise(j)
    return d.select("a", "b", F.round(s, 6).alias("score"))


@query("t32_extra_info", T.sql(
    "SELECT g.id, g.rep, coalesce(substr(arg_min(chunk, i), 1, 500), '') AS extra FROM g LEFT JOIN (SELECT id, i, any_value(chunk) AS chunk FROM k LEFT JOIN m USING (rep, token) GROUP BY id, i HAVING count(m.known) / count(*) < 0.72) c ON c.id = g.id GROUP BY 1, 2",
    "articles",
    **{n: _PAIR_CTES[n] for n in ("every", "titles")},
    g="SELECT id, rep FROM titles WHERE id <> rep",
    m=f"SELECT DISTINCT rep, unnest({Q.dedupe_tokens("title || ' ' || summary || ' ' || content")}) AS token, true AS known FROM articles JOIN (SELECT DISTINCT rep FROM g) ON rep = id",
    c0="SELECT id, rep, list_filter(list_transform(string_split_regex(summary || '. ' || content, '[.!?]'), lambda s: trim(s)), lambda s: length(s) >= 40) AS x FROM articles JOIN g USING (id)",
    k=f"SELECT id, rep, i, chunk, unnest({Q.dedupe_tokens('chunk')}) AS token FROM (SELECT id, rep, i, x[i] AS chunk FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM c0))",
))
def t32(spark: SparkSession, sf: str) -> DataFrame:
    """What an article adds to the first one of its title: its first longer sentence of which under 72 % of the tokens are there.

    Tokens are joined by group and token, so no text is compared with another in one row.
    """
    a = T.articles(spark, sf)
    g = _titles(spark, sf)[0].filter("id <> rep").select("id", "rep")
    whole = X.dedupe_tokens(F.concat_ws(" ", "title", "summary", "content"))
    m = a.join(g.select(F.col("rep").alias("id")).distinct(), "id").select(F.col("id").alias("rep"), F.explode(F.array_distinct(whole)).alias("token"), F.lit(1).alias("known"))
    parts = F.transform(F.split(F.concat_ws(". ", "summary", "content"), "[.!?]"), lambda s: F.trim(s))
    c = a.join(g, "id").select("id", "rep", F.posexplode(F.filter(parts, lambda s: F.length(s) >= 40)).alias("i", "chunk"))
    k = c.select("id", "rep", "i", F.explode(X.dedupe_tokens(F.col("chunk"))).alias("token"))
    new = k.join(m, ["rep", "token"], "left").groupBy("id", "i").agg((F.count("known") / F.count(F.lit(1))).alias("share")).filter("share < 0.72")
    first = new.groupBy("id").agg(F.min("i").alias("i"))
    found = c.join(first, ["id", "i"]).select("id", F.substring("chunk", 1, 500).alias("extra"))
    return g.join(found, "id", "left").select("id", "rep", F.coalesce("extra", F.lit("")).alias("extra"))


# --- stems and titles


@query("t06_story_titles", T.sql(f"SELECT id, {Q.story_title('title')} AS normal FROM articles", "articles"))
def t06(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, normal=X.story_title(F.col("title")))


def _stems_sql(stem: str) -> str:
    return T.sql(f"SELECT id, list_transform({Q.plain_words('title')}, lambda w: {stem}) AS stems FROM articles", "articles")


_BEFORE = "string_split_regex(w, '[''‘’]')[1]"


@query("t18_related_stems", _stems_sql(Q.stem(_BEFORE, X.RELATED_SUFFIXES)))
def t18(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, stems=F.transform(X.plain_words(F.col("title")), X.related_stem))


@query("t19_story_stems", _stems_sql(f"CASE WHEN regexp_matches(w, '[''‘’]') THEN {_BEFORE} ELSE {Q.stem('w', X.STORY_SUFFIXES)} END"))
def t19(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, stems=F.transform(X.plain_words(F.col("title")), X.story_stem))


@query("t20_comparison_stems", _stems_sql(Q.stem(Q.search_normal("string_split_regex(w, '[''’]')[1]"), X.COMPARISON_SUFFIXES)))
def t20(spark: SparkSession, sf: str) -> DataFrame:
    return _each(spark, sf, stems=F.transform(X.plain_words(F.col("title")), X.comparison_stem))


# --- classification


def _profile_sql() -> str:
    profiles = [Counter(w for k in words for w in k.split()) for words in CORPUS_RULES.values()]
    value = lambda p: " + ".join(f"CASE WHEN token = '{w}' THEN {n} ELSE 0 END" for w, n in p.items())
    dots = ", ".join(f"sum(tf * ({value(p)})) AS d{i}" for i, p in enumerate(profiles))
    rows = " UNION ALL ".join(f"SELECT id, {i} AS i, '{name}' AS label, d{i} / (sqrt(square) * {math.sqrt(sum(n * n for n in p.values()))!r}::double) AS near FROM z" for i, (name, p) in enumerate(zip(CORPUS_RULES, profiles, strict=True)))
    tokens = Q.dedupe_tokens("content")
    return T.sql(
        """SELECT id, CASE WHEN near > 0.025 THEN label ELSE 'Diğer' END AS category, CASE WHEN near > 0.025 THEN round(least(0.91::double, 0.35::double + near * 0.65::double + (near - second) * 0.30::double), 4) ELSE 0 END AS confidence
        FROM (SELECT *, lead(near) OVER w AS second, row_number() OVER w AS place FROM l WINDOW w AS (PARTITION BY id ORDER BY near DESC, i)) WHERE place = 1""",
        "articles",
        z=f"SELECT id, sum(tf * tf) AS square, {dots} FROM (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({tokens}) AS token FROM articles) GROUP BY 1, 2) GROUP BY 1",
        l=rows,
    )


@query("c02_profile_cosine", _profile_sql())
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return C.profile_cosines(T.articles(spark, sf).select("id", X.dedupe_tokens(F.col("content")).alias("tokens")), CORPUS_RULES)


@query("c03_arbiter", T.sql(
    f"""SELECT id, CASE WHEN n < 24 THEN 'Diğer' WHEN rule >= 0.85 THEN rc WHEN greatest(rule, own) < 0.55 THEN 'Diğer' WHEN own >= rule THEN pc ELSE rc END AS category,
      CASE WHEN n = 0 THEN 0 WHEN n < 24 THEN 0.18 WHEN rule >= 0.85 THEN rule ELSE least(0.98, greatest(rule, own)) END AS confidence,
      CASE WHEN n < 24 THEN 'fallback' WHEN rule >= 0.85 THEN 'keyword' WHEN greatest(rule, own) < 0.55 THEN 'fallback' WHEN own >= rule THEN 'ml' ELSE 'keyword' END AS origin
    FROM (SELECT a.id, a.n, coalesce(r.category, 'Diğer') AS rc, coalesce(r.confidence, 0)::double AS rule, coalesce(p.category, 'Diğer') AS pc, coalesce(p.confidence, 0)::double AS own
      FROM (SELECT id, length({Q.dedupe_normal("content")}) AS n FROM articles) a LEFT JOIN ({ORACLE["c01_keyword_category"]}) r ON r.id = a.id LEFT JOIN ({ORACLE["c02_profile_cosine"]}) p ON p.id = a.id)""",
    "articles",
))
def c03(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword rules and keyword profiles weighed against each other."""
    n = _normal(spark, sf)
    return C.arbitrate(n.select("id", F.length("normal").alias("length")), C.classify(n, CORPUS_RULES), c02(spark, sf))


@query("c14_unlabelled_queue", T.sql(f"SELECT id, category, confidence, confidence < 0.65 AS queued FROM ({ORACLE['c01_keyword_category']}) WHERE id NOT IN (SELECT article_id FROM article_categories WHERE is_human_label)", "article_categories"))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    """Articles without a human label, classified; unsure ones go to moderation."""
    human = T.article_categories(spark, sf).filter("is_human_label").select(F.col("article_id").alias("id"))
    d = C.classify(_normal(spark, sf).join(human, "id", "left_anti"), CORPUS_RULES)
    return d.withColumn("queued", F.col("confidence") < 0.65)


def _count_sql(k: str) -> str:
    return f"(len(string_split(normal, '{k}')) - 1)" if " " in k else f"len(list_filter(string_split(normal, ' '), lambda w: w = '{k}'))"


_COUNTED = " UNION ALL ".join(
    f"SELECT id, {i} AS i, '{name}' AS category, {' + '.join(_count_sql(k) for k in words)} AS hits, {' + '.join(f'CASE WHEN {_count_sql(k)} > 0 THEN 1 ELSE 0 END' for k in words)} AS terms FROM x WHERE length(normal) >= 20"
    for i, (name, words) in enumerate(CORPUS_RULES.items())
)


@query("c16_counted_rules", T.sql(
    "SELECT id, category, place, round(least(0.75::double, 0.45::double + hits * 0.08::double + least(0.12::double, terms * 0.02::double)), 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hits DESC, i) AS place FROM l WHERE hits >= 2) WHERE place <= 3",
    "articles", x=f"SELECT id, {Q.dedupe_normal('content')} AS normal FROM articles", l=_COUNTED,
))
def c16(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three categories by counted keywords."""
    return C.counted_rules(_normal(spark, sf).filter(F.length("normal") >= 20), CORPUS_RULES)


# --- scores


@query("m10_scrolled_rating", T.sql(f"SELECT event_id, round({T.TENTHS_SQL} / 10 * least(greatest(scroll_percent, 0) / 100, 1), 6) AS rating FROM user_events", "user_events"))
def m10(spark: SparkSession, sf: str) -> DataFrame:
    """An event's weight times how far the reader scrolled."""
    return T.user_events(spark, sf).select("event_id", F.round(T.tenths() / 10 * F.least(F.greatest(F.col("scroll_percent"), F.lit(0.0)) / 100, F.lit(1.0)), 6).alias("rating"))


#: Sources of one reader, in their order: title, category, tags, favorite, trust.
READER_SOURCES = [("src1", "genel", ["the"], True, "high"), ("src2", "the and", ["der", "la"], False, "low"), ("src3", "que", ["los", "und"], False, "medium"), ("src0", "die", ["xyz"], True, "high")]


def _boost_sql(h: str) -> str:
    out = "0::double"
    for title, category, tags, favorite, trust in READER_SOURCES:
        found = " OR ".join(f"contains({h}, '{t}')" for t in tags if len(t) > 2)
        add = f"CASE WHEN contains({h}, '{title}') THEN {5 if favorite else 3} ELSE 0 END"
        add += f" + CASE WHEN contains({h}, '{category}') THEN 1.5::double ELSE 0 END" if category != "genel" else ""
        out = f"(({out} + ({add} + CASE WHEN {found} THEN 1.5::double ELSE 0 END)) * { {'low': 0.8, 'high': 1.1}.get(trust, 1.0)}::double)"
    return f"round(least(8, {out}), 6)"


@query("m18_source_boost", T.sql(f"SELECT id, {_boost_sql('h')} AS boost FROM (SELECT id, {Q.search_normal("title || ' ' || summary || ' ' || source_name")} AS h FROM articles)", "articles"))
def m18(spark: SparkSession, sf: str) -> DataFrame:
    """Boost of articles by a reader's sources."""
    d = T.articles(spark, sf).select("id", X.search_normal(F.concat_ws(" ", "title", "summary", "source_name")).alias("h"))
    return d.select("id", F.round(S.source_boost(F.col("h"), READER_SOURCES), 6).alias("boost"))


@query("m26_weighted_vectors", T.sql(f"""SELECT user_id, category_id, round(s / 100 / total, 6) AS value FROM
  (SELECT user_id, category_id, sum(w * h) AS s FROM e JOIN (SELECT article_id, category_id, cast(round(confidence * 100) AS bigint) AS h FROM article_categories) c ON c.article_id = e.article_id GROUP BY 1, 2)
  JOIN (SELECT user_id, sum(w) AS total FROM e GROUP BY 1) USING (user_id) WHERE total > 0""", "user_events", "article_categories", e=f"SELECT user_id, article_id, sum({T.TENTHS_SQL}) AS w FROM user_events GROUP BY 1, 2"))  # fmt: skip
def m26(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's mean category vector: the articles' vectors added with the events' weights, over the weights' sum."""
    e = T.user_events(spark, sf).groupBy("user_id", "article_id").agg(F.sum(T.tenths()).alias("w"))
    c = T.article_categories(spark, sf).select("article_id", "category_id", F.round(F.col("confidence") * 100).cast("long").alias("h"))
    s = e.join(c, "article_id").groupBy("user_id", "category_id").agg(F.sum(F.col("w") * F.col("h")).alias("s"))
    total = e.groupBy("user_id").agg(F.sum("w").alias("total")).filter("total > 0")
    return s.join(total, "user_id").select("user_id", "category_id", F.round(F.col("s") / 100 / F.col("total"), 6).alias("value"))


# --- recommendation


@query("r24_interest_rerank", T.sql(
    """SELECT user_id, article_id, round(existing, 6) AS existing, round(interest, 6) AS interest, round(greatest(0, least(1, 0.70::double * existing + 0.30::double * interest)), 6) AS score
    FROM (SELECT user_id, article_id, CASE WHEN article_id % 3 = 0 THEN 0.5::double ELSE (article_id % 101) / 100 END AS existing, greatest(0, least(1, coalesce(num / den, 0.5))) AS interest
      FROM (SELECT k.user_id, k.article_id, sum(h * coalesce(share, 0)) / 100 AS num, sum(h) / 100 AS den FROM (SELECT DISTINCT user_id, article_id FROM user_events) k
        LEFT JOIN (SELECT article_id, category_id, cast(round(confidence * 100) AS bigint) AS h FROM article_categories) c ON c.article_id = k.article_id LEFT JOIN sh ON sh.user_id = k.user_id AND sh.category_id = c.category_id GROUP BY 1, 2))""",
    "user_events", "article_categories", w=_WEIGHTS, sh="SELECT user_id, category_id, w / sum(w) OVER (PARTITION BY user_id) AS share FROM w WHERE w > 0",
))
def r24(spark: SparkSession, sf: str) -> DataFrame:
    """Recommended articles ranked anew: .70 of their score (.5 where none is stored) and .30 of the reader's interest in their categories."""
    k = T.user_events(spark, sf).select("user_id", "article_id").distinct()
    c = T.article_categories(spark, sf).select("article_id", "category_id", F.round(F.col("confidence") * 100).cast("long").alias("h"))
    p = _profile(spark, sf).filter("w > 0")
    share = p.select("user_id", "category_id", (F.col("w") / F.sum("w").over(Window.partitionBy("user_id"))).alias("share"))
    d = k.join(c, "article_id", "left").join(share, ["user_id", "category_id"], "left").groupBy("user_id", "article_id")
    d = d.agg((F.sum(F.col("h") * F.coalesce("share", F.lit(0.0))) / 100).alias("num"), (F.sum("h") / 100).alias("den"))
    existing = F.when(F.col("article_id") % 3 == 0, 0.5).otherwise(F.col("article_id") % 101 / 100)
    d = d.select("user_id", "article_id", existing.alias("existing"), S.clamp01(F.coalesce(F.col("num") / F.col("den"), F.lit(0.5))).alias("interest"))
    score = S.clamp01(0.70 * F.col("existing") + 0.30 * F.col("interest"))
    return d.select("user_id", "article_id", F.round("existing", 6).alias("existing"), F.round("interest", 6).alias("interest"), F.round(score, 6).alias("score"))


_READS = "SELECT c.category_id, count(*) AS n FROM user_events e JOIN article_categories c ON c.article_id = e.article_id WHERE e.user_id = 1 AND e.event_type = 'READ' GROUP BY 1"


@query("r25_feed_relevance", T.sql(
    f"""SELECT id, cast(floor(greatest(0, least(100, least(100, c) * 0.35::double + least(100, q + 52) * 0.40::double + recency * 0.15::double + 50 * 0.10::double + CASE WHEN language = 'es' THEN 15 ELSE 0 END)) + 0.5::double) AS bigint) AS relevance
    FROM (SELECT *, CASE WHEN category_id IN (0, 2, 5) THEN 68 ELSE 48 END + q + least(18, floor(coalesce(n, 0) / (SELECT max(n) FROM reads) * 18 + 0.5::double)) AS c
      FROM (SELECT a.id, a.category_id, a.language, n, {ladder_sql("feed")} AS recency, CASE WHEN length(title) > 30 THEN 5 ELSE 0 END + CASE WHEN length(summary) > 100 THEN 10 ELSE 0 END + CASE WHEN trust_score >= 0.8 THEN 15 WHEN trust_score < 0.5 THEN -15 ELSE 0 END AS q
        FROM articles a JOIN sources s ON s.id = a.source_id LEFT JOIN reads r ON r.category_id = a.category_id))""",
    "articles", "sources", "user_events", "article_categories", reads=_READS,
))
def r25(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance for one reader: category with quality and own reads .35, subcategory with quality .40, recency .15, interaction .10, home language 15.

    The token overlap with articles read before and the reads of subcategories aren't part of it.
    """
    e = T.user_events(spark, sf).filter("user_id = 1 and event_type = 'READ'").select("article_id")
    reads = e.join(T.article_categories(spark, sf).select("article_id", "category_id"), "article_id").groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    most = reads.agg(F.max("n").alias("most")).scalar()
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    a = T.articles(spark, sf).select("id", "title", "summary", "language", "category_id", "source_id", "published_at")
    d = a.join(s, "source_id").join(F.broadcast(reads), "category_id", "left").withColumn("most", most)  # reads: one row a category
    q = F.when(F.length("title") > 30, 5).otherwise(0) + F.when(F.length("summary") > 100, 10).otherwise(0) + F.when(F.col("trust_score") >= 0.8, 15).when(F.col("trust_score") < 0.5, -15).otherwise(0)
    own = F.coalesce(F.least(F.lit(18), F.floor(F.coalesce("n", F.lit(0)) / F.col("most") * 18 + 0.5)), F.lit(0))
    category = F.least(F.lit(100), F.when(F.col("category_id").isin(0, 2, 5), 68).otherwise(48) + q + own)
    raw = category * 0.35 + F.least(F.lit(100), q + 52) * 0.40 + S.freshness(F.col("published_at"), T.as_of(), "feed") * 0.15 + 50 * 0.10 + F.when(F.col("language") == "es", 15).otherwise(0)
    return d.select("id", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) + 0.5).alias("relevance"))


@query("r28_panel_scores", T.sql(f"SELECT id, round(i * 3 + r * 1.4::double + least(25, share_count) + least(10, minutes), 6) AS headline, round(r * 1.2::double + i + share_count + CASE WHEN source_name <> '' THEN 6 ELSE 0 END, 6) AS trend FROM (SELECT *, view_count % 101 AS i, {ladder_sql('feed')} AS r, ceil(length(content) / 1000) AS minutes FROM articles)", "articles"))
def r28(spark: SparkSession, sf: str) -> DataFrame:
    """Headline candidates and the trend panel; shares stand for popularity, views modulo 101 for interest."""
    i, r = F.col("view_count") % 101, S.freshness(F.col("published_at"), T.as_of(), "feed")
    headline = i * 3 + r * 1.4 + F.least(F.lit(25), F.col("share_count")) + F.least(F.lit(10), F.ceil(F.length("content") / 1000))
    trend = r * 1.2 + i + F.col("share_count") + F.when(F.col("source_name") != "", 6).otherwise(0)
    return _each(spark, sf, headline=F.round(headline, 6), trend=F.round(trend, 6))


# --- lists, catalogs, events


@query("o09_reader_sorts", T.sql("(SELECT 'date' AS sort, id, row_number() OVER (ORDER BY published_at DESC, id) AS place FROM articles QUALIFY place <= 50) UNION ALL (SELECT 'popularity', id, row_number() OVER (ORDER BY view_count + share_count DESC, id) AS place FROM articles QUALIFY place <= 50) UNION ALL (SELECT 'relevance', id, row_number() OVER (ORDER BY id % 101 DESC, id) AS place FROM articles QUALIFY place <= 50)", "articles"))
def o09(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of a reader's three sort orders."""
    a = T.articles(spark, sf).select("id", F.col("published_at").alias("date"), (F.col("view_count") + F.col("share_count")).alias("popularity"), (F.col("id") % 101).alias("relevance"))
    out = None
    for c in ("date", "popularity", "relevance"):
        d = a.orderBy(F.desc(c), "id").limit(50)
        d = d.select(F.lit(c).alias("sort"), "id", F.row_number().over(Window.orderBy(F.desc(c), "id")).alias("place"))
        out = d if out is None else out.unionByName(d)
    return out


@query("f15_substring_search", T.sql(f"SELECT id, title FROM articles WHERE contains({Q.search_normal("title || ' ' || summary || ' ' || content")}, 'of the') AND category_id = 3 AND source_id % 2 = 0", "articles"))
def f15(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase anywhere in an article, with category and source; both go to the scan before the texts are looked at."""
    d = T.articles(spark, sf).filter("category_id = 3 and source_id % 2 = 0")
    return d.filter(X.search_normal(F.concat_ws(" ", "title", "summary", "content")).contains("of the")).select("id", "title")


_TYPES = ["youtube", "rss", "atom", "news", "blog", "podcast", "official"]


@query("f16_source_contents", T.sql(f"SELECT a.id, t = 'youtube' AS youtube, t IN ('rss', 'atom', 'news', 'blog', 'podcast') AS rss, t = 'official' OR category_id = 0 AS official, s.id IS NOT NULL AS favorite FROM (SELECT id, category_id, source_id, {_TYPES}[source_id % 7 + 1] AS t FROM articles) a LEFT JOIN (SELECT id FROM sources WHERE trust_score >= 0.8) s ON s.id = a.source_id", "articles", "sources"))
def f16(spark: SparkSession, sf: str) -> DataFrame:
    """Under which filters of the source page an article stands; trusted sources stand for favorites."""
    f = T.sources(spark, sf).filter("trust_score >= 0.8").select(F.col("id").alias("source_id"), F.lit(True).alias("favorite"))
    t = F.element_at(F.array(*(F.lit(x) for x in _TYPES)), F.col("source_id") % 7 + 1)
    d = T.articles(spark, sf).select("id", "category_id", "source_id", t.alias("t")).join(f, "source_id", "left")
    rss = F.col("t").isin("rss", "atom", "news", "blog", "podcast")
    return d.select("id", (F.col("t") == "youtube").alias("youtube"), rss.alias("rss"), ((F.col("t") == "official") | (F.col("category_id") == 0)).alias("official"), F.coalesce("favorite", F.lit(False)).alias("favorite"))


_CATALOG = "SELECT id, base_url || '/rss' AS rss_url, id % 9 AS category, id % 3 AS priority FROM sources"


@query("s13_source_catalog", T.sql("SELECT id, rss_url, category, priority FROM (SELECT *, row_number() OVER (PARTITION BY rss_url, category ORDER BY priority, id) AS place FROM (SELECT * FROM c UNION ALL SELECT id + 1000, rss_url, category, 1 FROM c WHERE id % 2 = 0)) WHERE place = 1", "sources", c=_CATALOG))
def s13(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed catalog and a reader's one, a feed once per category."""
    c = T.sources(spark, sf).select("id", F.concat("base_url", F.lit("/rss")).alias("rss_url"), (F.col("id") % 9).alias("category"), (F.col("id") % 3).alias("priority"))
    own = c.filter("id % 2 = 0").select((F.col("id") + 1000).alias("id"), "rss_url", "category", F.lit(1).alias("priority"))
    return feeds.source_catalog(c, own)


@query("s15_quote_cascade", "SELECT p_name AS symbol, coalesce(min(CASE WHEN p_size % 3 = 0 THEN p_retailprice END), min(CASE WHEN p_size % 5 = 0 THEN p_retailprice * 2 END)) AS value, CASE WHEN bool_or(p_size % 3 = 0) THEN 'first' WHEN bool_or(p_size % 5 = 0) THEN 'second' ELSE 'unavailable' END AS provider FROM (SELECT p_partkey AS p_name, p_size, p_retailprice FROM part) GROUP BY 1")
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol the first provider that has a quote; none is made up."""
    p = T.raw(spark, sf, "part")
    offer = lambda name, has, value: p.select(F.col("p_partkey").alias("symbol"), F.lit(name).alias("provider"), F.when(has, value).alias("value"))
    first = offer("first", F.col("p_size") % 3 == 0, F.col("p_retailprice"))
    return feeds.coalesced_quotes(first.unionByName(offer("second", F.col("p_size") % 5 == 0, F.col("p_retailprice") * 2)), ["first", "second"])


@query("d14_event_merge", "SELECT o_custkey, o_orderdate, arg_min(o_orderkey, (-q, o_orderkey)) AS main, min(price) AS price_min, max(price) AS price_max, max(q) AS popularity, count(DISTINCT o_orderpriority) AS source_count, count(*) AS events FROM (SELECT *, cast(round(o_totalprice * 100) AS bigint) AS price, o_orderkey % 97 AS q FROM orders) GROUP BY 1, 2")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    """Events of one title and date merged (customers stand for titles): main by quality, price range, highest popularity, number of sources."""
    d = T.raw(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), (F.col("o_orderkey") % 97).alias("q"))
    main = F.min_by("o_orderkey", F.struct(-F.col("q"), "o_orderkey")).alias("main")
    return d.groupBy("o_custkey", "o_orderdate").agg(main, F.min("price").alias("price_min"), F.max("price").alias("price_max"), F.max("q").alias("popularity"), F.size(F.collect_set("o_orderpriority")).cast("long").alias("source_count"), F.count(F.lit(1)).alias("events"))


@query("d16_stable_dedupe", f"SELECT key, min(page_id) AS kept, count(*) - 1 AS removed FROM (SELECT page_id, 'url:' || {Q.canonical_url('url')} AS key FROM (SELECT page_id, regexp_replace(url, '[0-9]+', '') AS url FROM pages)) GROUP BY 1")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of each stable key (the first number is cut from each url so that some are equal)."""
    key = F.concat(F.lit("url:"), X.canonical_url(F.regexp_replace("url", "^([^0-9]*)[0-9]+", "$1")))
    return T.raw(spark, sf, "pages").groupBy(key.alias("key")).agg(F.min("page_id").alias("kept"), (F.count(F.lit(1)) - 1).alias("removed"))


_MERGED = _REACH | {"u": "SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT id, id + 1 FROM k WHERE id % 50 = 0 AND id + 1 IN (SELECT id FROM k) UNION SELECT id + 1, id FROM k WHERE id % 50 = 0 AND id + 1 IN (SELECT id FROM k)"}


@query("d21_manual_merge", T.sql("SELECT node, min(seen) AS comp FROM r GROUP BY 1", "articles", **_MERGED))
def d21(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters after an editor merged some by hand (every fiftieth article with the next): the merges are links like any other."""
    ids = T.articles(spark, sf).select("id")
    manual = ids.filter("id % 50 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return G.components(_exact_links(spark, sf).unionByName(manual.join(ids.select(F.col("id").alias("b")), "b", "left_semi")))


@query("x14_reminders", f"SELECT o_orderkey, o_orderkey % 6 = 0 OR due AS sent, due AS notified FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 AND cast(o_orderdate AS timestamp) + INTERVAL 9000 DAYS <= {_NOW} AS due FROM orders)")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over calendar events (orders stand for them): enabled, unsent and due reminders are marked as sent and notified."""
    k = F.col("o_orderkey")
    due = (k % 2 == 0) & (k % 6 != 0) & (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 9000 DAYS") <= T.as_of())
    return T.raw(spark, sf, "orders").select("o_orderkey", ((k % 6 == 0) | due).alias("sent"), due.alias("notified"))
