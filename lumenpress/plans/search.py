"""Registered queries of search, similarity, duplicates, classification, recommendation and governance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as T
from ..functions import scoring as S
from ..functions import text as X
from ..operators import analytics as A
from ..operators import classify as C
from ..operators import graph as G
from ..operators import recommend as R
from ..operators import search as V
from ..scratch import saved
from . import sqltext as Q
from .analytics import _RATING, corrections, _CORRECTIONS
from .content import _HOURS, ladder_sql
from .registry import query

_NOW = f"TIMESTAMP '{T.AS_OF}'"
QUERY = "the and attion thanedble"


def _fields_sql(x: str) -> str:
    return f"list_sum(list_transform(qt, lambda t: CASE WHEN list_contains({x}, t) THEN 1.0::double WHEN len(list_filter({x}, lambda c: starts_with(c, t) OR starts_with(t, c))) > 0 THEN 0.65::double ELSE 0.0::double END))"


@query(
    "v01_field_search",
    T.sql(
        f"""SELECT id, score FROM (SELECT id, least(100, round(({_fields_sql("t1")} * 4 + {_fields_sql("t2")} * 3 + {_fields_sql("t3")} * 2 + {_fields_sql("t4")} + {_fields_sql("t5")} * 0.5
          + CASE WHEN contains(whole, phrase) THEN 5 ELSE 0 END) / (len(qt) * 10 + 5) * 100, 2)) AS score FROM f) WHERE score > 0""",
        "articles",
        "categories",
        f=f"""SELECT a.id, {Q.search_tokens("title")} AS t1, {Q.search_tokens("c.name")} AS t2, {Q.search_tokens("summary")} AS t3, {Q.search_tokens("substr(content, 1, 2500)")} AS t4, {Q.search_tokens("source_name")} AS t5,
          {Q.search_normal("(title || ' ' || c.name || ' ' || summary || ' ' || content || ' ' || source_name)")} AS whole, {Q.search_tokens(f"'{QUERY}'")} AS qt, {Q.search_normal(f"'{QUERY}'")} AS phrase FROM articles a JOIN categories c ON c.id = a.category_id""",
    ),
)
def v01(spark: SparkSession, sf: str) -> DataFrame:
    c = T.categories(spark).select(F.col("id").alias("category_id"), F.col("name").alias("labels"))
    a = T.articles(spark, sf).join(c, "category_id").withColumnRenamed("source_name", "source")
    return V.field_search(a, QUERY)


@query(
    "v02_search",
    T.sql(
        f"""SELECT id, title, score, cast(place AS int) AS place, total, total > 20 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC, id) AS place, count(*) OVER () AS total
        FROM (SELECT id, title, published_at, least(100, round(({_fields_sql("t1")} * 4 + {_fields_sql("t2")} * 3 + {_fields_sql("t3")} * 2 + {_fields_sql("t4")} + {_fields_sql("t5")} * 0.5
          + CASE WHEN contains(whole, phrase) THEN 5 ELSE 0 END) / (len(qt) * 10 + 5) * 100, 2)) AS score FROM f JOIN (SELECT id, title, published_at FROM articles WHERE category_id = 2 AND published_at >= {_NOW} - INTERVAL 20 DAYS) USING (id)) WHERE score > 0) WHERE place BETWEEN 11 AND 20""",
        "articles",
        "categories",
        f=f"""SELECT a.id, {Q.search_tokens("title")} AS t1, {Q.search_tokens("c.name")} AS t2, {Q.search_tokens("summary")} AS t3, {Q.search_tokens("substr(content, 1, 2500)")} AS t4, {Q.search_tokens("source_name")} AS t5,
          {Q.search_normal("(title || ' ' || c.name || ' ' || summary || ' ' || content || ' ' || source_name)")} AS whole, {Q.search_tokens(f"'{QUERY}'")} AS qt, {Q.search_normal(f"'{QUERY}'")} AS phrase FROM articles a JOIN categories c ON c.id = a.category_id""",
    ),
)
def v02(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten results of a query in one category and the last twenty days, end to end."""
    c = T.categories(spark).select(F.col("id").alias("category_id"), F.col("name").alias("labels"))
    a = T.articles(spark, sf).join(c, "category_id").withColumnRenamed("source_name", "source").withColumn("trend_score", F.lit(None).cast("double"))
    since = T.as_of() - F.expr("INTERVAL 20 DAYS")
    return V.search(a, f" {QUERY} <", category="ekonomi", since=since, page=2, limit=10).select("id", "title", "score", "place", "total", "has_more")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Index texts as the engine has them: title, summary and the first 500 characters of the content."""
    text = F.concat_ws(" ", "title", "summary", F.substring("content", 1, 500))
    return T.articles(spark, sf).filter("not is_duplicate").select("id", X.bm25_tokens(text).alias("tokens"))


_INDEX = f"SELECT id, {Q.bm25_tokens(chr(40) + 'title || chr(32) || summary || chr(32) || substr(content, 1, 500)' + chr(41))} AS tokens FROM articles WHERE NOT is_duplicate"
_TERMS = QUERY.split()


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(tokens, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    part = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * 2.5) / (tf{i} + 1.5 * (1 - 0.75 + 0.75 * len / mean)) ELSE 0 END" for i in range(len(_TERMS)))
    return f"""SELECT id, score FROM (SELECT id, round({part}, 6) AS score FROM t, (SELECT count(*) AS n, sum(len) / count(*) AS mean, {df} FROM t)) WHERE score >= 0.01""", f"SELECT id, len(tokens) AS len, {tf} FROM x WHERE len(tokens) > 0"


@query("v04_bm25", T.sql(_bm25_sql()[0], "articles", x=_INDEX, t=_bm25_sql()[1]))
def v04(spark: SparkSession, sf: str) -> DataFrame:
    return V.bm25(_indexed(spark, sf), _TERMS)


@query("v05_bm25_index", T.sql("SELECT token, count(*) AS df, sum(tf) AS total FROM (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(tokens) AS token FROM x) GROUP BY 1, 2) GROUP BY 1", "articles", x=_INDEX))
def v05(spark: SparkSession, sf: str) -> DataFrame:
    return V.term_statistics(_indexed(spark, sf))[1]


@query(
    "v06_advanced_search",
    T.sql(f"SELECT s.id, s.score, row_number() OVER (ORDER BY s.score DESC, s.id) AS rank FROM (SELECT * FROM ({_bm25_sql()[0]}) ORDER BY score DESC, id LIMIT 200) s JOIN articles a ON a.id = s.id WHERE language = 'en' ORDER BY rank LIMIT 20", "articles", x=_INDEX, t=_bm25_sql()[1]),
)
def v06(spark: SparkSession, sf: str) -> DataFrame:
    """The 200 best by BM25, filtered by language, the first page with ranks."""
    best = V.bm25(_indexed(spark, sf), _TERMS).orderBy(F.desc("score"), "id").limit(200)
    d = best.join(T.articles(spark, sf).filter("language = 'en'").select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(20)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(
    "v09_tfidf_titles",
    T.sql(
        """SELECT id, token, round(w / sqrt(cast(sum(cast(w * w AS decimal(38, 12))) OVER (PARTITION BY id) AS double)), 6) AS weight
        FROM (SELECT id, token, (1 + ln(tf)) * (ln(((SELECT count(*) FROM articles) + 1) / (count(*) OVER (PARTITION BY token) + 1)) + 1) AS w FROM tf)""",
        "articles",
        tf=f"SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({Q.dedupe_tokens('title')}) AS token FROM articles) GROUP BY 1, 2",
    ),
)
def v09(spark: SparkSession, sf: str) -> DataFrame:
    return V.tfidf(T.articles(spark, sf).select("id", X.dedupe_tokens(F.col("title")).alias("tokens")))


@query(
    "v10_tfidf_unique_tokens",
    T.sql(
        """SELECT id, token, round((1 / n) * (ln(((SELECT count(*) FROM articles) + 1) / (count(*) OVER (PARTITION BY token) + 1)) + 1), 6) AS weight FROM u""",
        "articles",
        u=f"SELECT id, unnest(t) AS token, len(t) AS n FROM (SELECT id, list_distinct({Q.dedupe_tokens('title')}) AS t FROM articles)",
    ),
)
def v10(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of distinct tokens, so that every term frequency is one over their number."""
    d = T.articles(spark, sf).select("id", F.array_distinct(X.dedupe_tokens(F.col("title"))).alias("t"))
    n = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    tf = d.select("id", F.explode("t").alias("token"), F.size("t").alias("n"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "token").select("id", "token", F.round((1 / F.col("n")) * (F.log((n + 1) / (F.col("df") + 1)) + 1), 6).alias("weight"))


@query("v11_corpus_terms", T.sql(f"SELECT token, round(count(*) * ln(((SELECT count(*) FROM articles) + 1) / (count(DISTINCT id) + 1)), 6) AS weight FROM (SELECT id, unnest({Q.dedupe_tokens('title')}) AS token FROM articles) GROUP BY 1 ORDER BY weight DESC, token LIMIT 15", "articles"))
def v11(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen most telling title terms of the corpus."""
    a = T.articles(spark, sf)
    n = a.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = a.select("id", F.explode(X.dedupe_tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("id").alias("df"))
    return d.select("token", F.round(F.col("c") * F.log((n + 1) / (F.col("df") + 1)), 6).alias("weight")).orderBy(F.desc("weight"), "token").limit(15)


_CENTROID = "SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, sum(cast(round(cast(v AS double) * 1000000) AS bigint)) / count(*) / 1000000 AS m FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1"


@query("v14_profile_cosine", f"WITH c AS ({_CENTROID}) SELECT vec_id, round(list_cosine_similarity(cast(embedding AS double[]), c), 5) AS cosine FROM embeddings JOIN c USING (label)")
def v14(spark: SparkSession, sf: str) -> DataFrame:
    """Dense cosine of every vector with the mean vector of its label."""
    e = T.raw(spark, sf, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg((F.sum(F.round(F.col("v").cast("double") * 1_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000).alias("m"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("c"))
    return e.join(c, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


#: Titles are paired from this Jaccard similarity of their token sets on. No pair with a story score of 0.68 has less.
PAIRED = 0.44
_PAIRS = f"""SELECT x.id AS a, y.id AS b, x.t AS ta, y.t AS tb, x.n AS na, y.n AS nb FROM
  (SELECT p.id AS a, q.id AS b, count(*) AS c FROM w p JOIN w q ON p.token = q.token AND p.id < q.id GROUP BY 1, 2) JOIN d x ON x.id = a JOIN d y ON y.id = b
  WHERE c / (len(list_distinct(x.t)) + len(list_distinct(y.t)) - c) >= {PAIRED}"""
_PAIR_CTES = {
    "every": f"SELECT id, {Q.dedupe_tokens('title')} AS t, {Q.dedupe_normal('title')} AS n FROM articles",
    "titles": "SELECT id, min(id) OVER (PARTITION BY list_sort(list_distinct(t))) AS rep FROM every WHERE len(t) > 0",
    "d": "SELECT * FROM every WHERE id IN (SELECT rep FROM titles)",
    "w": "SELECT id, unnest(list_distinct(t)) AS token FROM d",
    "p": _PAIRS,
}


def _titles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Articles (id, rep, n) by equal title tokens, and pairs (a, b) of such groups with their least articles' titles.

    Every pair of titles alike is found, through groups: equal titles are never paired with each other.
    """
    d = T.articles(spark, sf).select("id", X.dedupe_tokens(F.col("title")).alias("tokens"), X.dedupe_normal(F.col("title")).alias("n"))
    groups, pairs = V.jaccard_links(d, PAIRED)
    side = lambda c: d.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"), F.col("n").alias(f"n{c}"))
    return groups, saved(pairs, "title-pairs").join(side("a"), "a").join(side("b"), "b")


def _title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf)[1]


@query("j23_title_groups", T.sql("SELECT id, rep, count(*) OVER (PARTITION BY rep) AS n FROM titles", "articles", **{k: _PAIR_CTES[k] for k in ("every", "titles")}))
def j23(spark: SparkSession, sf: str) -> DataFrame:
    """The article that stands for each one's title in pairs of titles, and how many share it."""
    return _titles(spark, sf)[0]


@query("v15_jaccard_overlap", T.sql("SELECT a, b, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard, round(len(list_intersect(ta, tb)) / greatest(4, least(len(ta), len(tb))), 6) AS overlap FROM p", "articles", **_PAIR_CTES))
def v15(spark: SparkSession, sf: str) -> DataFrame:
    d = _title_pairs(spark, sf)
    return d.select("a", "b", F.round(V.jaccard(F.col("ta"), F.col("tb")), 6).alias("jaccard"), F.round(V.overlap(F.col("ta"), F.col("tb"), 4), 6).alias("overlap"))


_BG = "list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2))"


@query(
    "v17_dice_bigrams",
    T.sql(
        f"""SELECT a, b, round(2 * list_sum(list_transform(list_distinct(x), lambda g: least(len(list_filter(x, lambda w: w = g)), len(list_filter(y, lambda w: w = g))))) / (len(x) + len(y)), 6) AS dice
        FROM (SELECT a, b, {_BG.format("na")} AS x, {_BG.format("nb")} AS y FROM p WHERE na <> '' AND nb <> '')""",
        "articles",
        **_PAIR_CTES,
    ),
)
def v17(spark: SparkSession, sf: str) -> DataFrame:
    d = _title_pairs(spark, sf).filter("na <> '' and nb <> ''")
    return d.select("a", "b", F.round(V.dice(F.col("na"), F.col("nb")), 6).alias("dice"))


# --- duplicates and clusters

_KEYS = f"SELECT id, sha256({Q.dedupe_normal('content')}) AS c, {Q.title_normal('title')} || '|' || source_name AS t FROM articles"


def _exact_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of articles with equal content, or equal title and source, each to the least of its key."""
    a = T.articles(spark, sf)
    content = a.select("id", F.sha2(X.dedupe_normal(F.col("content")), 256).alias("key"))
    title = a.select("id", F.concat_ws("|", X.title_normal(F.col("title")), "source_name").alias("key"))
    links = None
    for d in (content, title):
        least = d.groupBy("key").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        d = d.join(least, "key").select(F.col("id").alias("a"), "b").filter("a <> b")
        links = d if links is None else links.unionByName(d)
    return links


_REACH = {
    "k": _KEYS,
    "e": "SELECT DISTINCT a, b FROM (SELECT id AS a, min(id) OVER (PARTITION BY c) AS b FROM k UNION ALL SELECT id, min(id) OVER (PARTITION BY t) FROM k) WHERE a <> b",
    "u": "SELECT a, b FROM e UNION SELECT b, a FROM e",
    "r": "SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen",
}


@query("d06_connected_components", T.sql("SELECT node, min(seen) AS comp FROM r GROUP BY 1", "articles", **_REACH))
def d06(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(_exact_links(spark, sf))


@query("d09_first_keeps")
def d09(spark: SparkSession, sf: str) -> DataFrame:
    """Articles that repeat an earlier kept one: going through ids in order, each linked to the least kept one."""
    d = T.articles(spark, sf).select("id", X.dedupe_tokens(F.col("title")).alias("tokens"))
    return G.first_keeps_sets(*V.jaccard_links(d, 0.5))


@query("d17_event_dedupe", "SELECT o_custkey, cast(o_orderdate AS date) AS event_date, min(o_orderkey) AS kept, count(*) - 1 AS dropped FROM orders GROUP BY 1, 2")
def d17(spark: SparkSession, sf: str) -> DataFrame:
    """One calendar event per title and date; the customer stands for the title."""
    return T.raw(spark, sf, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("event_date")).agg(F.min("o_orderkey").alias("kept"), (F.count(F.lit(1)) - 1).alias("dropped"))


@query("d20_ingest_gate", T.sql(f"SELECT id, CASE WHEN title = '' OR content = '' THEN 'incomplete' WHEN n > 1 THEN 'known' ELSE 'new' END AS decision FROM (SELECT id, title, content, row_number() OVER (PARTITION BY sha256({Q.dedupe_normal('content')}) ORDER BY id) AS n FROM articles)", "articles"))
def d20(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest does with each article: reject incomplete ones, skip known content."""
    d = T.articles(spark, sf).select("id", "title", "content", F.sha2(X.dedupe_normal(F.col("content")), 256).alias("key"))
    first = d.groupBy("key").agg(F.min("id").alias("first"))
    d = d.join(first, "key")
    return d.select("id", F.when((F.col("title") == "") | (F.col("content") == ""), "incomplete").when(F.col("id") > F.col("first"), "known").otherwise("new").alias("decision"))


# --- classification

#: Rules for the test corpus, whose words are invented: frequent words of each language stand for subjects.
CORPUS_RULES = C.parse_rules(
    """
    Gündem: the 1.5, and 1.2, of the 1.8
    Siyaset: der 2.0, die 1.5, und 1.8, von 1.4
    Ekonomi: le 1.8, de 2.0, que 1.6, les 1.5
    Spor: los 1.8, el 2.0, para 1.5, con 1.4
    Bilim: with 1.2, from 1.4, that 1.0
    """
)


def _normal(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).select("id", X.dedupe_normal(F.col("content")).alias("normal"))


def _hit(k: str) -> str:
    return f"contains(normal, '{k}')" if " " in k else f"contains(' ' || normal || ' ', ' {k} ')"


_SCORED = "SELECT id, normal, " + ", ".join("(" + " + ".join(f"CASE WHEN {_hit(k)} THEN {round(w * 100)} ELSE 0 END" for k, w in words.items()) + f") AS s{i}, (" + " + ".join(f"CASE WHEN {_hit(k)} THEN 1 ELSE 0 END" for k in words) + f") AS h{i}" for i, words in enumerate(CORPUS_RULES.values())) + f" FROM (SELECT id, {Q.dedupe_normal('content')} AS normal FROM articles)"
_LONG = " UNION ALL ".join(f"SELECT id, length(normal) AS n, '{name}' AS label, {i} AS i, s{i} AS s, h{i} AS h FROM x" for i, name in enumerate(CORPUS_RULES))


@query(
    "c01_keyword_category",
    T.sql(
        """SELECT id, CASE WHEN best = 0 THEN 'Diğer' ELSE label END AS category, CASE WHEN best = 0 THEN 0 ELSE round(least(0.98, CASE WHEN label = 'Siyaset' AND best < 2.8 THEN least(0.74, conf) WHEN label = 'Gündem' AND second >= best * 0.85 THEN least(0.78, conf) ELSE conf END), 4) END AS confidence
        FROM (SELECT *, 0.45 + least(0.3::double, best / 12) + least(0.2::double, (best - second) / 7) + least(0.08::double, h * 0.015::double) AS conf
          FROM (SELECT id, label, h, s / 100 AS best, lead(s) OVER w / 100 AS second, row_number() OVER w AS rank FROM l WINDOW w AS (PARTITION BY id ORDER BY s DESC, i)) WHERE rank = 1)""",
        "articles",
        x=_SCORED,
        l=_LONG,
    ),
)
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(_normal(spark, sf), CORPUS_RULES)


_LABELS = "SELECT id, label, s, h, round(1 / (1 + exp(-least(greatest(-2.65::double + (s / 100) * 0.92::double + least(0.35::double, h * 0.08::double) + least(0.25::double, n / 700), -40), 40))), 4) AS score FROM l"


@query("c05_multilabel", T.sql("SELECT id, label, score, score >= 0.56 AND (s >= 125 OR h >= 2 OR score >= 0.72) AS assigned FROM g", "articles", x=_SCORED, l=_LONG, g=_LABELS))
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return C.label_scores(_normal(spark, sf), CORPUS_RULES)


_CANDIDATES = [0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


@query(
    "c06_best_thresholds",
    T.sql(
        f"""SELECT label, threshold, f1 FROM (SELECT label, threshold, f1, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, threshold) AS rank
        FROM (SELECT label, threshold, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 9) ELSE 0 END AS f1
          FROM (SELECT label, threshold, count(*) FILTER (score >= threshold AND actual) AS tp, count(*) FILTER (score >= threshold AND NOT actual) AS fp, count(*) FILTER (score < threshold AND actual) AS fn
            FROM (SELECT g.label, g.score, q.quality = 1 AS actual FROM g JOIN labels q ON q.doc_id = g.id), (SELECT unnest({_CANDIDATES}::double[]) AS threshold) GROUP BY 1, 2))) WHERE rank = 1""",
        "articles",
        x=_SCORED,
        l=_LONG,
        g=_LABELS,
    ),
)
def c06(spark: SparkSession, sf: str) -> DataFrame:
    """Per label the best threshold against human labels (quality stands for the target)."""
    target = T.raw(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("actual"))
    return C.best_thresholds(C.label_scores(_normal(spark, sf), CORPUS_RULES).join(target, "id"), _CANDIDATES)


def _lang_sql() -> str:
    hits = lambda hints: " + ".join(f"CASE WHEN contains(low, '{h}') THEN 1 ELSE 0 END" for h in hints)
    return f"""SELECT id, CASE WHEN sure >= 0.85 THEN lang ELSE 'unknown' END AS lang, round(sure, 3) AS confidence FROM (SELECT id,
      CASE WHEN length(t) < 20 THEN 'unknown' WHEN ar > 8 THEN 'ar' WHEN cy > 8 THEN 'ru' WHEN tr >= 2 OR trh >= 2 THEN 'tr' WHEN enh >= 2 OR (words >= 8 AND tr = 0) THEN 'en' ELSE 'unknown' END AS lang,
      CASE WHEN length(t) < 20 THEN 0 WHEN ar > 8 THEN 0.94 WHEN cy > 8 THEN 0.91 WHEN tr >= 2 OR trh >= 2 THEN least(0.99::double, 0.82::double + tr * 0.025::double + trh * 0.04::double) WHEN enh >= 2 OR (words >= 8 AND tr = 0) THEN least(0.96::double, 0.78::double + enh * 0.05::double) ELSE 0.55 END AS sure
      FROM (SELECT *, {hits(C.EN_HINTS)} AS enh, {hits(C.TR_HINTS)} AS trh FROM (SELECT id, t, ' ' || {Q.lower_tr("t")} || ' ' AS low, len(regexp_extract_all(t, '[çğıİöşüÇĞÖŞÜ]')) AS tr, len(regexp_extract_all(t, '[\\x{{0600}}-\\x{{06FF}}]')) AS ar, len(regexp_extract_all(t, '[\\x{{0400}}-\\x{{04FF}}]')) AS cy, len(regexp_extract_all(t, '[A-Za-zÇĞİÖŞÜçğıöşü]{{2,}}')) AS words
        FROM (SELECT id, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 1200) AS t FROM articles))))"""


@query("c17_language", T.sql(_lang_sql(), "articles"))
def c17(spark: SparkSession, sf: str) -> DataFrame:
    return T.articles(spark, sf).withColumn("l", C.language(F.col("content"))).select("id", "l.lang", "l.confidence")


@query("c21_keywords", T.sql(f"SELECT id, list(token ORDER BY n DESC, token)[1:12] AS keywords FROM (SELECT id, token, count(*) AS n FROM (SELECT id, unnest({Q.dedupe_tokens('content')}) AS token FROM articles) GROUP BY 1, 2) GROUP BY 1", "articles"))
def c21(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve most frequent tokens of each article."""
    d = T.articles(spark, sf).select("id", F.explode(X.dedupe_tokens(F.col("content"))).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "token"))
    d = d.withColumn("rank", rank).filter("rank <= 12")
    return d.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("keywords"))


_ENTITIES = {"people": r"(?:^|[^\p{L}])[A-Z][a-z]+ [A-Z][a-z]+(?:\z|[^\p{L}])", "money": r"(?:^|[^0-9])[0-9]+([.,][0-9]+)? ?(TL|USD|EUR|euro)(?:\z|[^\p{L}])", "organisations": r"(?:^|[^\p{L}])[A-Z][A-Z0-9&.-]{2,}"}


@query("c23_entities", T.sql("SELECT id, " + ", ".join(f"len(regexp_extract_all(content, '{p}')) AS {k}" for k, p in _ENTITIES.items()) + " FROM articles", "articles"))
def c23(spark: SparkSession, sf: str) -> DataFrame:
    """How many persons, sums of money and organisations the patterns find."""
    return T.articles(spark, sf).select("id", *(F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0))).alias(k) for k, p in _ENTITIES.items()))


@query("c32_moderation", "SELECT doc_id, CASE WHEN contains(lower(text), 'worthless') OR contains(lower(text), 'pathetic') OR (doc_id % 100) / 100 >= 0.95 THEN 'REJECTED' WHEN (doc_id % 100) / 100 >= 0.7 THEN 'PENDING' ELSE 'APPROVED' END AS status FROM documents")
def c32(spark: SparkSession, sf: str) -> DataFrame:
    """Moderation with a toxicity score as a column (here made from the id)."""
    return T.raw(spark, sf, "documents").select("doc_id", C.moderation(F.col("text"), F.col("doc_id") % 100 / 100, ["worthless", "pathetic"]).alias("status"))


@query("c15_llm_gate", T.sql("SELECT id, CASE WHEN id % 97 = 0 THEN 'manual' WHEN confidence < 0.65 THEN 'low_confidence' WHEN n = 0 THEN 'no_label' WHEN category_id NOT IN (SELECT category_id FROM article_categories c WHERE c.article_id = a.id AND confidence >= 0.6) THEN 'model_conflict' ELSE '' END AS reason FROM articles a JOIN (SELECT article_id, min(confidence) AS confidence, count(*) AS n FROM article_categories GROUP BY 1) ON article_id = id", "articles", "article_categories"))
def c15(spark: SparkSession, sf: str) -> DataFrame:
    """Why an article would be sent to a slower classifier; empty where it wouldn't."""
    c = T.article_categories(spark, sf).groupBy("article_id").agg(F.min("confidence").alias("confidence"), F.collect_set(F.when(F.col("confidence") >= 0.6, F.col("category_id"))).alias("labels"), F.count(F.lit(1)).alias("n"))
    d = T.articles(spark, sf).join(c, F.col("id") == F.col("article_id"))
    reason = F.when(F.col("id") % 97 == 0, "manual").when(F.col("confidence") < 0.65, "low_confidence").when(F.col("n") == 0, "no_label").when(~F.array_contains("labels", F.col("category_id")), "model_conflict").otherwise("")
    return d.select("id", reason.alias("reason"))


# --- recommendation

_COUNTS = f"SELECT news_id, count(*) FILTER (interaction_type = 'view') AS views, count(*) FILTER (interaction_type = 'share') AS shares, count(*) FILTER (interaction_type = 'search_click') AS search_clicks FROM interactions WHERE created_at >= {_NOW} - INTERVAL 72 HOURS GROUP BY 1"


@query(
    "r01_trend_mix",
    T.sql(
        f"""SELECT id, round((CASE WHEN max(v) OVER () > 0 THEN v / max(v) OVER () * 100 ELSE 0 END) * 0.4::double + (CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () * 100 ELSE 0 END) * 0.3::double + (CASE WHEN max(c) OVER () > 0 THEN c / max(c) OVER () * 100 ELSE 0 END) * 0.2::double + ({ladder_sql("search")}) * 0.1::double, 2) AS trend_score
        FROM (SELECT id, published_at, coalesce(nullif(views, 0), least(view_count, 20)) AS v, coalesce(nullif(shares, 0), least(share_count, 20)) AS s, coalesce(search_clicks, 0) AS c FROM articles LEFT JOIN n ON news_id = id WHERE published_at >= {_NOW} - INTERVAL 24 HOURS)""",
        "articles",
        "interactions",
        n=_COUNTS,
    ),
)
def r01(spark: SparkSession, sf: str) -> DataFrame:
    i = T.interactions(spark, sf).filter(F.col("created_at") >= T.as_of() - F.expr("INTERVAL 72 HOURS"))
    counts = i.groupBy("news_id").agg(*(A.count_if(F.col("interaction_type") == k).alias(n) for n, k in (("views", "view"), ("shares", "share"), ("search_clicks", "search_click"))))
    return R.trend_mix(T.articles(spark, sf), counts, T.as_of())


@query("r03_temporal_trend", T.sql(f"SELECT id, round(view_count * exp(-0.05 * {_HOURS}), 6) AS score FROM articles WHERE NOT is_duplicate AND published_at >= {_NOW} - INTERVAL 168 HOURS AND language = 'en' ORDER BY score DESC, id LIMIT 20", "articles"))
def r03(spark: SparkSession, sf: str) -> DataFrame:
    d = T.articles(spark, sf).filter("not is_duplicate and language = 'en'").filter(F.col("published_at") >= T.as_of() - F.expr("INTERVAL 168 HOURS"))
    return d.select("id", F.round(S.decayed_views(F.col("view_count"), F.col("published_at"), T.as_of()), 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("r04_headline_priority", T.sql(f"SELECT a.id, round(least(1, greatest(0, 0.4::double * 0.5 + 0.3::double * exp(-0.05 * {_HOURS}) + 0.2::double * log10(1 + view_count) / max(log10(1 + view_count)) OVER () + 0.1::double * trust_score)), 6) AS priority FROM articles a JOIN sources s ON s.id = a.source_id", "articles", "sources"))
def r04(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    return R.priority(T.articles(spark, sf).join(s, "source_id"), F.lit(0.5), F.col("trust_score"), T.as_of())


_SIMS = """SELECT a.user_id, b.user_id AS other, round(cast(sum(cast(a.rating AS decimal(12, 6)) * cast(b.rating AS decimal(12, 6))) AS double) / (any_value(x.n) * any_value(y.n)), 6) AS sim
  FROM g a JOIN g b ON a.article_id = b.article_id AND a.user_id <> b.user_id JOIN nn x ON x.user_id = a.user_id JOIN nn y ON y.user_id = b.user_id GROUP BY 1, 2"""
_G = "SELECT user_id, article_id, max(rating) AS rating FROM rated GROUP BY 1, 2 HAVING max(rating) > 0"
_NN = "SELECT user_id, sqrt(cast(sum(cast(rating AS decimal(12, 6)) * cast(rating AS decimal(12, 6))) AS double)) AS n FROM g GROUP BY 1"


def _ratings(spark: SparkSession, sf: str) -> DataFrame:
    return A.ratings(T.user_events(spark, sf)).select("user_id", "article_id", "rating").filter("rating > 0")


@query("r08_user_similarity", T.sql("SELECT * FROM sims", "user_events", rated=_RATING, g=_G, nn=_NN, sims=_SIMS))
def r08(spark: SparkSession, sf: str) -> DataFrame:
    return R.user_similarities(_ratings(spark, sf))


_NEAR = "SELECT user_id, other, sim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS n FROM sims WHERE sim > 0) WHERE n <= {}"
_BASE = {"rated": _RATING, "g": _G, "nn": _NN, "sims": _SIMS}


@query(
    "r08_user_cf",
    T.sql(
        """SELECT user_id, article_id, round(s * 100 / max(s) OVER (PARTITION BY user_id), 2) AS score FROM (SELECT near.user_id, g.article_id, sum(cast(round(sim * rating * 1000000) AS bigint)) AS s
        FROM near JOIN g ON g.user_id = other WHERE (near.user_id, g.article_id) NOT IN (SELECT user_id, article_id FROM g) GROUP BY 1, 2)""",
        "user_events",
        **_BASE,
        near=_NEAR.format(10) + " AND user_id IN (SELECT user_id FROM g GROUP BY 1 HAVING count(*) >= 3)",
    ),
)
def r08_cf(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of unread articles from the ten nearest users, for readers of three articles and more."""
    r = _ratings(spark, sf)
    return R.user_cf(r, R.user_similarities(r, most=10), least_items=3)


@query(
    "r14_mean_centred_cf",
    T.sql(
        """SELECT x.user_id, x.article_id, round(m.mean + x.up / x.down, 4) AS score FROM (SELECT near.user_id, g.article_id, sum(cast(round(sim * (rating - mean) * 1000000) AS bigint)) AS up, sum(cast(round(sim * 1000000) AS bigint)) AS down
        FROM near JOIN g ON g.user_id = other JOIN m ON m.user_id = other WHERE (near.user_id, g.article_id) NOT IN (SELECT user_id, article_id FROM g) GROUP BY 1, 2) x JOIN m ON m.user_id = x.user_id""",
        "user_events",
        **_BASE,
        near=_NEAR.format(20),
        m="SELECT user_id, sum(cast(round(rating * 1000000) AS bigint)) / count(*) / 1000000 AS mean FROM g GROUP BY 1",
    ),
)
def r14(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted ratings from the twenty nearest users' deviations from their means."""
    r = _ratings(spark, sf)
    return R.mean_centred_cf(r, R.user_similarities(r))


@query("r22_cold_start", T.sql(f"SELECT a.id, round(0.4::double * (CASE WHEN published_at >= {_NOW} - INTERVAL 48 HOURS THEN 1 ELSE 0.35 END) + 0.3::double * view_count / max(view_count) OVER () + 0.3::double * trust_score, 6) AS score FROM articles a LEFT JOIN sources s ON s.id = a.source_id WHERE NOT is_duplicate AND language = 'en'", "articles", "sources"))
def r22(spark: SparkSession, sf: str) -> DataFrame:
    """Popular, recent and trusted articles for readers without a history."""
    a = T.articles(spark, sf).filter("not is_duplicate and language = 'en'")
    top = a.agg(F.max("view_count").alias("m")).scalar()
    s = T.sources(spark, sf).select(F.col("id").alias("source_id"), "trust_score")
    fresh = F.when(F.col("published_at") >= T.as_of() - F.expr("INTERVAL 48 HOURS"), 1.0).otherwise(0.35)
    return a.join(s, "source_id", "left").select("id", F.round(0.4 * fresh + F.lit(0.3) * F.col("view_count") / top + 0.3 * F.coalesce("trust_score", F.lit(0.5)), 6).alias("score"))


@query("r23_adaptive_interests")
def r23(spark: SparkSession, sf: str) -> DataFrame:
    """Interest weights folded over each user's events in order."""
    return R.adaptive_interests(T.user_events(spark, sf), T.article_categories(spark, sf))


@query("r30_upcoming_events", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND o_orderdate <= TIMESTAMP '1995-06-01 00:00:00' + INTERVAL 30 DAYS ORDER BY o_orderdate, o_orderkey LIMIT 50")
def r30(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")
    d = T.raw(spark, sf, "orders").filter((F.col("o_orderdate") >= start) & (F.col("o_orderdate") <= start + F.expr("INTERVAL 30 DAYS")))
    return d.orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_orderdate")


# --- governance and state transitions


@query("g01_latest_correction", T.sql("SELECT admin_id, status, arg_max(article_id, (corrected_at, article_id)) AS article_id FROM c GROUP BY 1, 2", c=_CORRECTIONS))
def g01(spark: SparkSession, sf: str) -> DataFrame:
    """The latest correction wins per administrator and state."""
    return corrections(spark, sf).groupBy("admin_id", "status").agg(F.max_by("article_id", F.struct("corrected_at", "article_id")).alias("article_id"))


@query("g02_second_verification", T.sql("SELECT article_id, NOT list_has_any(original, corrected) AND admin_id IN (1, 2) AS requires_verification FROM c", c=_CORRECTIONS))
def g02(spark: SparkSession, sf: str) -> DataFrame:
    """Reviewers (here administrators 1 and 2) need a second look where no label survived."""
    return corrections(spark, sf).select("article_id", (~F.arrays_overlap("original", "corrected") & F.col("admin_id").isin(1, 2)).alias("requires_verification"))


@query("g03_verified_weight", T.sql("SELECT article_id, CASE WHEN is_verified THEN round(weight * 1.3, 4) ELSE weight END AS weight FROM c", c=_CORRECTIONS))
def g03(spark: SparkSession, sf: str) -> DataFrame:
    return corrections(spark, sf).select("article_id", F.when(F.col("is_verified"), F.round(F.col("weight") * 1.3, 4)).otherwise(F.col("weight")).alias("weight"))


@query("g04_weighted_dataset", T.sql("SELECT article_id, unnest(range(1, cast(ceil(weight) AS int) + CASE WHEN is_verified THEN 1 ELSE 0 END + 1)) AS copy FROM c", c=_CORRECTIONS))
def g04(spark: SparkSession, sf: str) -> DataFrame:
    """A copy per started unit of weight, one more if verified."""
    n = F.ceil("weight").cast("int") + F.col("is_verified").cast("int")
    return corrections(spark, sf).select("article_id", F.explode(F.sequence(F.lit(1), n)).alias("copy"))


@query("g05_retrain_trigger", T.sql("SELECT count(*) FILTER (status = 'processed') AS processed, count(*) FILTER (status = 'processed') >= 100 OR count(*) FILTER (corrected_at >= TIMESTAMP '2024-01-30 00:00:00') >= 30 AS due FROM c", c=_CORRECTIONS))
def g05(spark: SparkSession, sf: str) -> DataFrame:
    processed = A.count_if(F.col("status") == "processed")
    today = A.count_if(F.col("corrected_at") >= T.as_of() - F.expr("INTERVAL 1 DAY"))
    return corrections(spark, sf).agg(processed.alias("processed"), ((processed >= 100) | (today >= 30)).alias("due"))


@query("g07_retrain_gate", "SELECT count(*) AS pairs, count(DISTINCT quality) AS classes, min(n) AS smallest, count(*) >= 50 AND count(DISTINCT quality) >= 2 AND min(n) >= 3 AS ready FROM (SELECT quality, count(*) OVER (PARTITION BY quality) AS n FROM labels)")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    """Enough labels, classes, and labels per class to train on."""
    d = T.raw(spark, sf, "labels").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))
    d = d.agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"))
    return d.withColumn("ready", (F.col("pairs") >= 50) & (F.col("classes") >= 2) & (F.col("smallest") >= 3))


@query("g08_human_label_replaces", T.sql("SELECT article_id, category_id FROM article_categories WHERE article_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, cast(quality + 2 * toxic AS int) FROM labels", "article_categories"))
def g08(spark: SparkSession, sf: str) -> DataFrame:
    """A human label takes the place of all categories of an article."""
    human = T.raw(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("category_id"))
    rest = T.article_categories(spark, sf).join(human, "article_id", "left_anti").select("article_id", "category_id")
    return rest.unionByName(human)


@query("k01_insert_ignore", T.sql("SELECT DISTINCT url FROM articles WHERE id % 2 = 0 UNION SELECT url FROM articles WHERE id % 2 = 1 AND id % 3 = 0", "articles"))
def k01(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a target and those new rows whose url it doesn't have."""
    a = T.articles(spark, sf).select("id", "url")
    target = a.filter("id % 2 = 0").select("url").distinct()
    new = a.filter("id % 3 = 0").select("url").distinct().join(target, "url", "left_anti")
    return target.unionByName(new)


@query("k03_report_rows", T.sql("SELECT 'events' AS metric_type, event_type AS key, count(*) AS value FROM user_events GROUP BY 2 UNION ALL SELECT 'articles', language, count(*) FROM articles GROUP BY 2", "articles", "user_events"))
def k03(spark: SparkSession, sf: str) -> DataFrame:
    """A report as flat rows (metric_type, key, value), ready for a csv file."""
    e = T.user_events(spark, sf).groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric_type", F.lit("events"))
    a = T.articles(spark, sf).groupBy(F.col("language").alias("key")).agg(F.count(F.lit(1)).alias("value")).withColumn("metric_type", F.lit("articles"))
    return e.unionByName(a)


@query("k06_icalendar", "SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || chr(13) || chr(10) || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || chr(13) || chr(10) || 'DTEND:' || strftime(o_orderdate + INTERVAL 2 HOURS, '%Y%m%dT%H%M%SZ') || chr(13) || chr(10) || 'END:VEVENT' AS ics FROM orders")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar entries of two hours."""
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    at = F.col("o_orderdate")
    return T.raw(spark, sf, "orders").select("o_orderkey", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("o_orderkey").cast("string")), F.concat(F.lit("DTSTART:"), stamp(at)), F.concat(F.lit("DTEND:"), stamp(at + F.expr("INTERVAL 2 HOURS"))), F.lit("END:VEVENT")).alias("ics"))


@query("k08_recommendation_upsert", T.sql("SELECT coalesce(n.id, o.id) AS id, CASE WHEN o.status IN ('clicked', 'dismissed') THEN o.status ELSE 'active' END AS status, coalesce(n.score, o.score) AS score FROM (SELECT id, view_count AS score FROM articles WHERE id % 2 = 0) n FULL JOIN (SELECT id, share_count AS score, CASE id % 3 WHEN 0 THEN 'clicked' WHEN 1 THEN 'dismissed' ELSE 'active' END AS status FROM articles WHERE id % 5 = 0) o ON n.id = o.id", "articles"))
def k08(spark: SparkSession, sf: str) -> DataFrame:
    """New recommendations over old ones; clicked and dismissed ones keep their state."""
    a = T.articles(spark, sf)
    new = a.filter("id % 2 = 0").select("id", F.col("view_count").alias("score"))
    old = a.filter("id % 5 = 0").select("id", F.col("share_count").alias("old_score"), F.element_at(F.array(F.lit("clicked"), F.lit("dismissed"), F.lit("active")), (F.col("id") % 3 + 1).cast("int")).alias("old_status"))
    d = new.join(old, "id", "full")
    return d.select("id", F.when(F.col("old_status").isin("clicked", "dismissed"), F.col("old_status")).otherwise("active").alias("status"), F.coalesce("score", "old_score").alias("score"))


@query("k12_bounded_append", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def k12(spark: SparkSession, sf: str) -> DataFrame:
    """The last five thousand entries of a log."""
    return T.raw(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id")


@query("s11_page_metadata", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS language, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(lower(url), '://(?:www\\.)?([^/:?#]+)', 1) AS publisher FROM pages")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """Language, title and publisher of a page from its markup, the host standing in for a missing publisher."""
    html = F.col("html")
    return T.raw(spark, sf, "pages").select("page_id", F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("language"), F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(F.lower("url"), r"://(?:www\.)?([^/:?#]+)", 1).alias("publisher"))


@query("s09_listing_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def s09(spark: SparkSession, sf: str) -> DataFrame:
    """All links of crawled pages."""
    return T.raw(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("x08_notification_states", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderdate > TIMESTAMP '1995-01-01 00:00:00' THEN 'pending' WHEN o_orderkey % 4 >= 3 THEN 'failed' ELSE 'retry' END AS state, o_orderkey % 4 AS retries FROM orders")
def x08(spark: SparkSession, sf: str) -> DataFrame:
    """One step of the notification machine: due ones are sent, or tried again up to three times."""
    k = F.col("o_orderkey")
    due = F.col("o_orderdate") <= F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    state = F.when(F.col("o_orderstatus") == "F", "sent").when(~due, "pending").when(k % 4 >= 3, "failed").otherwise("retry")
    return T.raw(spark, sf, "orders").select("o_orderkey", state.alias("state"), (k % 4).alias("retries"))


@query("x11_due_reports", "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_custkey = orders.o_custkey AND strftime(d.o_orderdate, '%Y-%m') = strftime(orders.o_orderdate, '%Y-%m') AND d.o_orderstatus = 'F') GROUP BY 1, 2")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    """Reports due in a period that haven't run in it: an anti join on schedule and period."""
    o = T.raw(spark, sf, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    done = o.filter("o_orderstatus = 'F'").select("o_custkey", "period").distinct()
    return o.join(done, ["o_custkey", "period"], "left_anti").groupBy("o_custkey", "period").agg(F.count(F.lit(1)).alias("n"))
