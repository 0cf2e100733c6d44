"""Search and similarity: weighted fields, BM25, TF-IDF, set and sequence similarities, MinHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import saved


def field_count(field: Column, query: Column) -> Column:
    """How many query tokens a field has: one for an equal token, 0.65 for one that is a beginning of the other."""
    hit = F.transform(query, lambda t: F.when(F.array_contains(field, t), F.lit(1.0)).when(F.exists(field, lambda c: c.startswith(t) | t.startswith(c)), F.lit(0.65)).otherwise(F.lit(0.0)))
    return F.aggregate(hit, F.lit(0.0), lambda acc, x: acc + x)


# Weights of the fields of an article.
FIELD_WEIGHTS = {"title": 4.0, "labels": 3.0, "summary": 2.0, "content": 1.0, "source": 0.5}


def field_search(articles: DataFrame, query: str, content_chars: int = 2500) -> DataFrame:
    """(id, score) of articles with a score, by weighted field matches and five for the whole phrase.

    articles: id, title, labels, summary, content, source. The content field is its beginning, as the scoring
    rule has it; the phrase is looked for everywhere.
    """
    # the query's tokens once, as constants: as expressions they would be computed for every row
    asked = articles.sparkSession.range(1).select(X.search_tokens(X.sanitize_query(F.lit(query))).alias("q"), X.search_normal(X.sanitize_query(F.lit(query))).alias("p")).first()
    q, phrase = F.array(*(F.lit(t) for t in asked["q"])).cast("array<string>"), F.lit(asked["p"])
    fields = {"title": F.col("title"), "labels": F.col("labels"), "summary": F.col("summary"), "content": F.substring("content", 1, content_chars), "source": F.col("source")}
    d = articles.select("id", X.search_normal(F.concat_ws(" ", "title", "labels", "summary", "content", "source")).alias("all"), *(X.search_tokens(c, distinct=True).alias(f"t_{k}") for k, c in fields.items()))
    raw = sum((field_count(F.col(f"t_{k}"), q) * w for k, w in FIELD_WEIGHTS.items()), F.lit(0.0)) + F.when(F.col("all").contains(phrase), 5.0).otherwise(0.0)
    score = F.least(F.lit(100.0), F.round(raw / (len(asked["q"]) * 10 + 5) * 100, 2))
    # a filter on the score would be pushed below it and compute it twice
    return d.select("id", F.explode(F.filter(F.array(score), lambda s: s > 0)).alias("score"))


# Rows of a page, at most and where none are asked for; sort modes and what they go by before the time.
MOST_ROWS, ROWS = 100, 20
SORTS = {"relevance": "score", "most_read": "view_count", "most_shared": "share_count", "trend": "trend_score", "newest": None, "latest": None}


def search(articles: DataFrame, query: str = "", category: str = "", source: str = "", since: Column | None = None, until: Column | None = None, sort: str = "", page: int = 1, limit: int = ROWS) -> DataFrame:
    """A page of search results: articles' columns with score, place (from 1 over all pages), total and has_more.

    articles: id, title, labels, summary, content, source, published_at, view_count, share_count, trend_score. Filters come
    before scores. Without a query nothing is scored and the newest come first; with one only articles with a score count.
    A category or source fits if its search form equals the article's; times are from since, before until.

    Defined cases: an unknown sort is by relevance; a page beyond the last is empty; undated articles fit no range and come
    last; equal rows go by id. The page alone is sorted, by a top-k of its last place.
    """
    page, limit = max(1, page), min(MOST_ROWS, max(1, limit))
    asked = articles.sparkSession.range(1).select(X.sanitize_query(F.lit(query)).alias("q"), *(X.search_normal(X.sanitize_query(F.lit(v))).alias(k) for k, v in (("c", category), ("s", source)))).first()
    d = articles
    for name, want in (("labels", asked["c"]), ("source", asked["s"])):
        if want:
            d = d.filter(X.search_normal(F.col(name)) == want)
    if since is not None:
        d = d.filter(F.col("published_at") >= since)
    if until is not None:
        d = d.filter(F.col("published_at") < until)
    if asked["q"]:
        d = d.join(field_search(d, query), "id")
    else:
        d = d.withColumn("score", F.lit(0.0))
    d = saved(d.drop("content"), "search-found")
    by = SORTS.get((sort or ("relevance" if asked["q"] else "newest")).lower(), "score")
    order = [*([F.desc_nulls_last(by)] if by else []), F.desc_nulls_last("published_at"), F.col("id")]
    top = d.orderBy(*order).limit(page * limit)
    total = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # page * limit rows
    return placed.filter(F.col("place") > (page - 1) * limit).withColumn("total", total).withColumn("has_more", F.col("total") > page * limit)


def _is(term: str):
    return lambda w: w == F.lit(term)


def bm25(docs: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75, least: float = 0.01) -> DataFrame:
    """(id, score) of docs (id, tokens) by BM25; a repeated query term counts again.

    One scan counts the query's terms in each document's tokens, one aggregate gives their document frequencies
    and the mean length; no inverted index is shuffled for a single query.
    """
    terms = list(dict.fromkeys(query))
    d = docs.filter(F.size("tokens") > 0).select("id", F.size("tokens").alias("len"), *(F.size(F.filter("tokens", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = d.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.count(F.lit(1))).alias("avg"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))))
    whole = stats.select(F.struct("*")).scalar()
    d = d.withColumn("s", whole)
    score = F.lit(0.0)
    for t in query:
        i = terms.index(t)
        tf, df = F.col(f"tf{i}"), F.col("s")[f"df{i}"]
        idf = F.log(1 + (F.col("s")["n"] - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("len") / F.col("s")["avg"]))).otherwise(0.0)
    return d.select("id", F.round(score, 6).alias("score")).filter(F.col("score") >= least)


def term_statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index of docs (id, tokens): (id, token, tf) and (token, df, total)."""
    tf = docs.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    return tf, tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))


def pair_bm25(docs: DataFrame, pairs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(a, b, score) of pairs of docs (id, tokens): mean BM25 of each for the other's terms over the larger one for its own."""
    tf, df = term_statistics(docs)
    size = docs.select("id", F.size("tokens").alias("len")).filter("len > 0")
    whole = size.agg(F.count(F.lit(1)).alias("n"), (F.sum("len") / F.count(F.lit(1))).alias("avg")).select(F.struct("*")).scalar()
    d = tf.join(df.select("token", "df"), "token").join(size, "id").withColumn("s", whole)
    idf = F.log((F.col("s")["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    long = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(F.col("s")["avg"], F.lit(1.0)))
    w = saved(d.select("id", "token", (idf * F.col("tf") * (k1 + 1) / long).alias("w")), "term-weights")
    own = w.groupBy("id").agg(F.sum("w").alias("own"))
    side = lambda t, c: t.withColumnsRenamed({x: x if x == "token" else c if x == "id" else f"{x}_{c}" for x in t.columns})
    both = pairs.select("a", "b").join(side(w, "a"), "a").join(side(w, "b"), ["b", "token"])
    both = both.groupBy("a", "b").agg(F.sum(F.col("w_a") + F.col("w_b")).alias("shared"))
    d = pairs.select("a", "b").join(both, ["a", "b"], "left").join(side(own, "a"), "a").join(side(own, "b"), "b")
    score = F.coalesce("shared", F.lit(0.0)) / 2 / F.greatest("own_a", "own_b", F.lit(0.001))
    return d.select("a", "b", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


def tfidf(docs: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, token, weight) of docs (id, tokens): (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), of length one per document."""
    tf, df = term_statistics(docs)
    n = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    w = (1 + F.log("tf") if sublinear else F.col("tf")) * (F.log((n + 1) / (F.col("df") + 1)) + 1)
    d = tf.join(df.select("token", "df"), "token").withColumn("w", w)
    norm = d.groupBy("id").agg(F.sqrt(F.sum((F.col("w") * F.col("w")).cast("decimal(38,12)")).cast("double")).alias("norm"))
    return d.join(norm, "id").select("id", "token", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def overlap(a: Column, b: Column, least: int) -> Column:
    """Shared elements over the smaller set's size, which counts as at least ``least``."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(least), F.least(F.size(a), F.size(b)))


def bigrams(x: Column) -> Column:
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 2), ""))
    return X.once(F.filter(F.split(x, ""), lambda c: c != ""), pairs)


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the bags of character bigrams of two normal texts."""
    x, y = bigrams(a), bigrams(b)
    shared = F.aggregate(F.array_distinct(x), F.lit(0), lambda acc, g: acc + F.least(F.size(F.filter(x, lambda w: w == g)), F.size(F.filter(y, lambda w: w == g))))
    return F.when((a == "") | (b == ""), 0.0).otherwise(2 * shared / (F.size(x) + F.size(y)))


def jaccard_links(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All pairs of docs (id, tokens) whose token sets have a Jaccard similarity of at least ``least``, as two tables.

    Tokens are compared by hashes of 64 bits. Equal sets are put together first: (id, rep, n) has each document's set by its least id, and how many documents
    have it. The pairs (a, b), a < b, are those of different sets, by their least ids. Documents without tokens are left out.

    No pair is lost: sets of sizes m >= k need ``shared`` = least / (1 + least) * (m + k) equal tokens, so their first
    m - shared + 1 and k - shared + 1 tokens, rarest first, have one in common.
    """
    d = saved(docs.select("id", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.xxhash64(t)))).alias("set")).filter(F.size("set") > 0), "token-sets")
    sets = saved(d.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "token-sets")
    t = sets.select("rep", F.explode("set").alias("token"))
    t = t.join(t.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    t = t.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("set"))
    t = saved(t.withColumn("m", F.size("set")), "token-orders")
    shared = F.ceil(least / (1 + least) * (F.col("m") + F.col("k")) - 1e-9).cast("int")

    def keyed(sizes: Column, *names: str) -> DataFrame:
        x = t.withColumn("k", F.explode(sizes))
        x = x.withColumn("token", F.explode(F.slice("set", 1, F.greatest(F.col("m") - shared + 1, F.lit(0)))))
        return x.select("token", F.greatest("m", "k").alias("longer"), F.least("m", "k").alias("shorter"), *(F.col(c).alias(n) for c, n in zip(("rep", "set"), names, strict=True)))

    long = keyed(F.sequence(F.greatest(F.ceil(least * F.col("m") - 1e-9).cast("int"), F.lit(1)), F.col("m")), "p", "ps")
    short = keyed(F.sequence(F.col("m"), F.floor(F.col("m") / least + 1e-9).cast("int")), "q", "qs")
    both = long.join(short, ["token", "longer", "shorter"]).filter("p < q or (p > q and longer > shorter)").filter(jaccard(F.col("ps"), F.col("qs")) >= least)
    pairs = both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return d.join(sets, "set").select("id", "rep", "n"), pairs


def minhash_sha1(shingles: Column, permutations: int = 96) -> Column:
    """Signature of seeded SHA-1: per seed the least of the first 32 bits over the shingles."""
    value = lambda k, s: F.substring(F.sha1(F.concat(k.cast("string"), F.lit(":"), s)), 1, 8)
    # eight hexadecimal digits are ordered like the numbers they stand for
    least = lambda own: F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda k: F.conv(F.array_min(F.transform(own, lambda s: value(k, s))), 16, 10).cast("bigint"))
    return X.once(X.once(shingles, lambda own: F.when(F.size(own) > 0, own).otherwise(F.array(F.lit("__empty__")))), least)


def bands(signature: Column, n: int = 24) -> Column:
    """The signature's bands as keys ``band:values``."""

    def keys(g: Column) -> Column:
        rows = (F.size(g) / n).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(k.cast("string"), F.lit(":"), F.array_join(F.transform(F.slice(g, k * rows + 1, rows), lambda v: v.cast("string")), "|")))

    return X.once(signature, keys)
