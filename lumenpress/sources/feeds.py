"""Sources and sinks of content: feeds, provider payloads, article tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def _field(item: Column, *names: str) -> Column:
    """The first of the tags that isn't empty, CDATA unwrapped, references decoded, markup dropped."""
    found = []
    for n in names:
        raw = F.regexp_replace(F.regexp_extract(item, rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
        found.append(F.nullif(F.trim(X.strip_html(X.decode_entities(raw))), F.lit("")))
    return F.coalesce(*found)


def feed_items(feeds: DataFrame, xml: str = "xml", keep: list[str] | None = None, least_title: int = 15) -> DataFrame:
    """Items of RSS and entries of Atom feeds: kept columns with title, url, summary, published_at.

    An item needs a url and a title of some length; unreadable dates are null.
    """
    keep = [c for c in feeds.columns if c != xml] if keep is None else keep
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)(?:\s[^>]*)?>(.*?)</\1>"), F.lit(2))
    d = feeds.select(*keep, F.explode(items).alias("__item"))
    i = F.col("__item")
    link = F.coalesce(_field(i, "link"), F.nullif(F.regexp_extract(i, r"""(?is)<link[^>]*href=["']([^"']+)""", 1), F.lit("")))
    date = _field(i, "pubDate", "published", "updated")
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace(date, r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(date))
    d = d.select(*keep, _field(i, "title").alias("title"), link.alias("url"), _field(i, "description", "summary", "content").alias("summary"), when.alias("published_at"))
    return d.filter(F.col("url").isNotNull() & (F.length("title") >= least_title))


# Where providers' payloads keep their articles and fields.
PROVIDERS = {
    "newsapi": ("articles", {"title": "title", "url": "url", "summary": "description", "published_at": "publishedAt"}),
    "guardian": ("response.results", {"title": "webTitle", "url": "webUrl", "summary": "webTitle", "published_at": "webPublicationDate"}),
}


def provider_articles(payloads: DataFrame, provider: str, column: str = "payload") -> DataFrame:
    """Articles of a provider's JSON payloads: title, url, summary, published_at."""
    path, fields = PROVIDERS[provider]
    inner = f"array<struct<{', '.join(f'{c}:string' for c in dict.fromkeys(fields.values()))}>>"
    schema = inner
    for part in reversed(path.split(".")):
        schema = f"struct<{part}:{schema}>"
    d = payloads.select(F.from_json(column, schema).alias("p")).select(F.explode(f"p.{path}").alias("a"))
    d = d.select(*(F.col(f"a.{c}").alias(k) for k, c in fields.items()))
    return d.withColumn("published_at", F.try_to_timestamp("published_at")).filter("title is not null and url is not null")


def source_catalog(*catalogs: DataFrame) -> DataFrame:
    """Catalogs united: one row per feed url and category, the lowest priority number first, then the lowest id."""
    d = catalogs[0]
    for c in catalogs[1:]:
        d = d.unionByName(c, allowMissingColumns=True)
    best = d.groupBy("rss_url", "category").agg(F.min_by(F.struct(*d.columns), F.struct("priority", "id")).alias("s"))
    return best.select("s.*")


def coalesced_quotes(quotes: DataFrame, order: list[str]) -> DataFrame:
    """Per symbol the first provider's value that isn't missing; ``unavailable`` where none has one, never a made-up number."""
    rank = F.array_position(F.array(*(F.lit(p) for p in order)), F.col("provider"))
    d = quotes.withColumn("__rank", F.when(F.col("value").isNotNull() & (rank > 0), rank))
    best = d.groupBy("symbol").agg(F.min_by(F.struct("value", "provider"), "__rank").alias("q"), F.min("__rank").alias("r"))
    return best.select("symbol", F.when(F.col("r").isNotNull(), F.col("q.value")).alias("value"), F.when(F.col("r").isNotNull(), F.col("q.provider")).otherwise("unavailable").alias("provider"))


def flat_report(sections: dict[str, DataFrame], date: str) -> DataFrame:
    """Report sections of (key, value) as rows (metric_type, key, value, date)."""
    out = None
    for name, d in sections.items():
        d = d.select(F.lit(name).alias("metric_type"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.lit(date).alias("date"))
        out = d if out is None else out.unionByName(d)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A report as csv with a header, as UTF-8; one file per partition."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


# Words of an event's raw kind and its category, first match.
EVENT_ALIASES = [
    ("konser|müzik|music|jazz|rock|dj|akustik", "Konser"),
    ("tiyatro|sahne|müzikal|opera|bale|oyun", "Tiyatro"),
    ("festival|fest|şenlik|kültür yolu", "Festival"),
    (r"stand\s*-?up|komedi|gösteri", "Stand-up"),
    ("spor|maç|futbol|basket|voleybol|stadyum", "Spor"),
    ("sergi|müze|galeri|bienal|dijital sanat", "Sergi"),
    ("atölye|workshop|eğitim|seminer", "Atölye"),
    ("fuar|expo", "Fuar"),
    ("söyleşi|panel|konferans", "Söyleşi"),
    ("kültür|sanat|opera|bale|klasik müzik", "Kültür Sanat"),
    ("çocuk|aile|kids", "Çocuk"),
]


def event_category(raw: Column) -> Column:
    """The category of an event's raw kind: the first alias that fits, else the kind itself, ``Etkinlik`` where there is none."""
    found = F
    for words, name in EVENT_ALIASES:
        found = found.when(raw.rlike(f"(?i){words}"), name)
    return found.when(F.coalesce(raw, F.lit("")).isin("", "Tümü"), "Etkinlik").otherwise(raw)


def event_price(raw: Column) -> Column:
    """The number in a price text: null for none, 0 where the text has no digit, null where it isn't one number."""
    digits = F.regexp_replace(F.regexp_replace(raw, "[^0-9.,]", ""), "^([^,]*),", "$1.")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).when(digits == "", 0.0).otherwise(digits.try_cast("double"))


def normal_events(raw: DataFrame) -> DataFrame:
    """Events of (source, source_id, kind, title, start, venue, price): stable id, category, price, whether free."""
    kind = F.coalesce(F.nullif("kind", F.lit("")), "title")
    key = F.concat_ws("|", "source", "source_id", "title", F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"), "venue")
    price = event_price(F.col("price"))
    return raw.select(
        F.concat(X.slug(F.col("source")), F.lit("_"), F.substring(F.sha1(key), 1, 12)).alias("id"), "title", event_category(kind).alias("category"), price.alias("price"),
        (F.coalesce(price == 0, F.lit(False)) | F.coalesce(F.col("price"), F.lit("")).rlike("(?i)ücretsiz|free")).alias("is_free"),
    )


def jsonld_items(docs: DataFrame, column: str = "jsonld") -> DataFrame:
    """Items of JSON-LD texts, flattened: the item, those of its @graph and main entities below either; by type and headline."""
    item = "`@type`:string,headline:string"
    inner = f"struct<{item},mainEntity:struct<{item}>>"
    d = docs.withColumn("__p", F.from_json(column, f"struct<{item},mainEntity:struct<{item}>,`@graph`:array<{inner}>>"))
    flat = lambda c: F.struct(c["@type"].alias("type"), c["headline"].alias("headline"))
    graph = F.coalesce("__p.@graph", F.array().cast(f"array<{inner}>"))
    every = F.concat(F.array(flat(F.col("__p")), flat(F.col("__p.mainEntity"))), F.transform(graph, flat), F.transform(graph, lambda g: flat(g["mainEntity"])))
    d = d.select(*docs.columns, F.explode(every).alias("__i")).filter("__i.type is not null")
    return d.select(*(c for c in docs.columns if c != column), "__i.type", "__i.headline")


def old_files(spark: SparkSession, folder: str, before: Column) -> DataFrame:
    """(path, modified_at) of a folder's files last changed before a time; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return d.select("path", F.col("modificationTime").alias("modified_at")).filter(F.col("modified_at") < before)
