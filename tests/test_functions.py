"""Literal cases of the text, scoring, search, classification and graph rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenpress.functions import scoring as S
from lumenpress.functions import text as X
from lumenpress.operators import classify as C
from lumenpress.operators import graph as G
from lumenpress.operators import search as V
from lumenpress.sources import feeds


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Şirket BÜYÜDÜ", "sirket buyudu"), ("İstanbul'da IŞIK", "istanbulda isik"), ("  a\tb\n", "a b"), ("", ""), (None, ""), ("x-y_z!", "x-y z")],
)
def test_search_normal(spark, text, want):
    assert one(spark, X.search_normal(F.lit(text))) == want


def test_titles_and_keys(spark):
    assert one(spark, X.title_normal(F.lit("SON DAKİKA: Büyük Deprem"))) == "büyük deprem"
    assert one(spark, X.dedupe_normal(F.lit("<b>IĞDIR</b> & İzmir"))) == "ığdır izmir"
    assert one(spark, X.slug(F.lit("  Çok Güzel! Haber "))) == "cok-guzel-haber"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://WWW.Example.com/news/1/?utm_source=x&b=2&a=1&fbclid=9#top", "https://example.com/news/1?a=1&b=2"),
        ("http://example.com", "http://example.com/"),
        ("not a url#x", "not a url"),
        (None, ""),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, X.canonical_url(F.lit(url))) == want


def test_stemmer_takes_the_first_suffix_in_order(spark):
    assert one(spark, X.search_stem(F.lit("evlerinden"))) == "evler"  # the longer suffixes would leave too little
    assert one(spark, X.search_stem(F.lit("kitaplarindan"))) == "kitap"
    assert one(spark, X.search_tokens(F.lit("Yeni haberler ve kitaplar"))) == ["kitap"]  # haber is a stop word


def test_shingles(spark):
    words = F.array(*map(F.lit, ["a", "b", "c", "d"]))
    assert one(spark, X.word_shingles(words)) == ["a b c", "b c d"]
    assert one(spark, X.word_shingles(F.array(F.lit("a"), F.lit("a")))) == ["a"]
    assert one(spark, X.char_shingles(F.lit("abcdef"))) == ["abcde", "bcdef"]


@pytest.mark.parametrize(("hours", "want"), [(0, 100), (1, 100), (1.01, 90), (6, 90), (24, 75), (72, 50), (168, 30), (169, 10)])
def test_freshness_boundaries(spark, hours, want):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    when = F.timestamp_micros(F.unix_micros(now) - F.lit(int(hours * 3600e6)))
    assert one(spark, S.freshness(when, now, "search")) == want
    assert one(spark, S.freshness(F.lit(None).cast("timestamp"), now, "feed")) == 45


def test_similarities(spark):
    a, b = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcd"))
    assert one(spark, V.jaccard(a, b)) == 0.5
    assert one(spark, V.dice(F.lit("abcd"), F.lit("abce"))) == pytest.approx(4 / 6)
    assert one(spark, V.dice(F.lit(""), F.lit("abce"))) == 0.0
    sig = one(spark, V.minhash_sha1(F.array(F.lit("x y z")), 8))
    assert len(sig) == 8 and all(0 <= v < 2**32 for v in sig)


def test_bm25_counts_repeated_terms(spark):
    d = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"]), (4, [])], "id long, tokens array<string>")
    once = {r.id: r.score for r in V.bm25(d, ["a"]).collect()}
    twice = {r.id: r.score for r in V.bm25(d, ["a", "a"]).collect()}
    assert set(once) == {1, 2} and all(twice[k] == pytest.approx(2 * once[k], abs=2e-6) for k in once)


def test_diacritics_dont_matter_in_search(spark):
    d = spark.createDataFrame([(1, "Şirket büyüdü", "Ekonomi", "s", "c", "x"), (2, "Hava güzel", "Yaşam", "s", "c", "x")], "id long, title string, labels string, summary string, content string, source string")
    assert [r.id for r in V.field_search(d, "sirket").collect()] == [1]


RULES = C.parse_rules("Spor: futbol 2.0, maç 1.8, süper lig 2.2\nEkonomi: dolar 2.0, faiz 1.8, merkez bankası 2.2\nSiyaset: seçim 2.0, meclis 1.8")


def test_keyword_categories(spark):
    rows = [(1, "süper lig maç futbol"), (2, "merkez bankası faiz dolar"), (3, "hava"), (4, "seçim")]
    got = {r.id: (r.category, r.confidence) for r in C.classify(spark.createDataFrame(rows, "id long, normal string"), RULES).collect()}
    assert got[1][0] == "Spor" and got[1][1] > 0.85
    assert got[2][0] == "Ekonomi" and got[3] == ("Diğer", 0.0)
    assert got[4][0] == "Siyaset" and got[4][1] <= 0.74


def test_label_scores_are_independent(spark):
    got = C.label_scores(spark.createDataFrame([(1, "futbol maç dolar faiz")], "id long, normal string"), RULES).collect()
    assert {r.label for r in got if r.assigned} == {"Spor", "Ekonomi"} and sum(r.score for r in got) > 1


def test_language(spark):
    say = lambda t: one(spark, C.language(F.lit(t)))["lang"]
    assert say("The market and the government said this with others from here") == "en"
    assert say("Türkiye için önemli bir açıklama yapıldı ve ekonomi büyüdü") == "tr"
    assert say("Правительство объявило новые меры поддержки") == "ru"
    assert say("short") == "unknown" and say(None) == "unknown"


def test_moderation(spark):
    say = lambda t, s: one(spark, C.moderation(F.lit(t), F.lit(s), ["bad"]))
    assert [say("fine", 0.1), say("so BAD", 0.1), say("fine", 0.7), say("fine", 0.95)] == ["APPROVED", "REJECTED", "PENDING", "REJECTED"]


def test_components_and_greedy_choice(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)]
    d = spark.createDataFrame(links, "a long, b long")
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    near: dict[int, set[int]] = {}
    for a, b in links:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    got = {r.node: r.comp for r in G.components(d).collect()}
    assert got == {n: find(n) for n in near}
    kept: set[int] = set()
    for n in sorted(near):
        if not any(m in kept for m in near[n] if m < n):
            kept.add(n)
    chosen = {r.node: (r.kept, r.by) for r in G.first_keeps(d).collect()}
    assert chosen == {n: (n in kept, None if n in kept else min(m for m in near[n] if m in kept and m < n)) for n in near}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_feed_items(spark):
    xml = """<rss><channel><item><title><![CDATA[A long enough title &amp; more]]></title><link>https://x.org/1</link><description>&lt;p&gt;Hi&lt;/p&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
    <item><title>short</title><link>https://x.org/2</link></item></channel></rss>"""
    atom = '<feed><entry><title>Another long enough title</title><link href="https://x.org/3"/><updated>2024-01-02T00:00:00Z</updated></entry></feed>'
    got = feeds.feed_items(spark.createDataFrame([(1, xml), (2, atom), (3, None), (4, "")], "id int, xml string")).orderBy("id").collect()
    assert [(r.id, r.title, r.url) for r in got] == [(1, "A long enough title & more", "https://x.org/1"), (2, "Another long enough title", "https://x.org/3")]
    assert all(r.published_at is not None for r in got)


def test_providers_catalogs_quotes(spark):
    p = spark.createDataFrame([('{"articles":[{"title":"T","url":"u","description":"d","publishedAt":"2024-01-01T00:00:00Z"},{"url":"v"}]}',), ("broken",)], "payload string")
    assert [(r.title, r.url) for r in feeds.provider_articles(p, "newsapi").collect()] == [("T", "u")]
    g = spark.createDataFrame([('{"response":{"results":[{"webTitle":"T","webUrl":"u","webPublicationDate":"2024-01-01T00:00:00Z"}]}}',)], "payload string")
    assert feeds.provider_articles(g, "guardian").count() == 1
    c = spark.createDataFrame([(2, "r", "a", 1), (1, "r", "a", 1), (3, "r", "b", 9)], "id int, rss_url string, category string, priority int")
    assert sorted(r.id for r in feeds.source_catalog(c, c).collect()) == [1, 3]
    q = spark.createDataFrame([("USD", "a", None), ("USD", "b", 3.0), ("EUR", "a", None)], "symbol string, provider string, value double")
    assert {r.symbol: (r.value, r.provider) for r in feeds.coalesced_quotes(q, ["a", "b"]).collect()} == {"USD": (3.0, "b"), "EUR": (None, "unavailable")}


def test_insert_ignore_stream(spark, tmp_path):
    from lumenpress.streaming import jobs

    schema = "url string, n int"
    for k, rows in enumerate([[("a", 1), ("b", 1), ("a", 2)], [("b", 3), ("c", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.insert_ignore(stream, str(tmp_path / "out"), checkpoint=str(tmp_path / "c"))
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
