"""Literal cases of feeds, events, phrase rules, light language detection and bullets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lumenpress.functions import text as X
from lumenpress.operators import classify as C
from lumenpress.sources import feeds


def one(spark, column, *values):
    """The column's values over single-text rows, in order."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.v for r in d.select("i", column.alias("v")).orderBy("i").collect()]


def test_event_price(spark):
    assert one(spark, feeds.event_price(F.col("t")), "12,50 TL", "100", "ücretsiz", "", None, "10.5 - 20.5", "1,234,5") == [12.5, 100.0, 0.0, None, None, None, None]


def test_event_category(spark):
    assert one(spark, feeds.event_category(F.col("t")), "Jazz gecesi", "STAND UP", "Opera ve bale", "Kids", "Gezi", "Tümü", "", None) == ["Konser", "Stand-up", "Tiyatro", "Çocuk", "Gezi", "Etkinlik", "Etkinlik", "Etkinlik"]


def test_normal_events_are_stable_and_free(spark):
    row = ("City Guide", "7", None, "Rock night", datetime(2024, 2, 1, 20), "Hall", "Free entry")
    d = spark.createDataFrame([row, row, (*row[:6], None)], "source string, source_id string, kind string, title string, start timestamp, venue string, price string")
    got = feeds.normal_events(d).collect()
    assert len({r.id for r in got}) == 1 and got[0].id.startswith("city-guide_") and len(got[0].id) == len("city-guide_") + 12
    assert [(r.category, r.price, r.is_free) for r in got] == [("Konser", 0.0, True), ("Konser", 0.0, True), ("Konser", None, False)]


def test_jsonld_items(spark):
    text = '{"@type": "A", "mainEntity": {"@type": "B", "headline": "b"}, "@graph": [{"@type": "C", "mainEntity": {"@type": "D"}}]}'
    d = spark.createDataFrame([(1, text), (2, "{}"), (3, None), (4, "no json")], "id int, jsonld string")
    assert sorted((r.id, r.type, r.headline) for r in feeds.jsonld_items(d).collect()) == [(1, "A", None), (1, "B", "b"), (1, "C", None), (1, "D", None)]


def test_old_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert feeds.old_files(spark, str(tmp_path), F.lit("2000-01-01").cast("timestamp")).count() == 0
    assert feeds.old_files(spark, str(tmp_path), F.current_timestamp() + F.expr("INTERVAL 1 DAY")).count() == 1


RULES = {"first": ["alpha", "beta"], "second": ["gamma", "delta two"], "third": ["eps"]}


def test_most_hits(spark):
    t = ("alpha gamma", "gamma delta two alpha", "none", "", "eps")
    assert one(spark, C.most_hits(F.col("t"), RULES, "-"), *t) == ["first", "second", "-", "-", "third"]
    assert one(spark, C.most_hits(F.col("t"), RULES, "-", 2), *t) == ["-", "second", "-", "-", "-"]
    assert one(spark, C.most_hits(F.col("t"), RULES, "-", 1, frozenset({"alpha", "eps"})), *t) == ["second", "second", "-", "-", "-"]


def test_longest_phrase_and_mentions(spark):
    t = ("alpha delta two", "eps.", "steps", "", None)
    assert one(spark, C.longest_phrase(F.col("t"), RULES, "-"), *t) == ["second", "third", "third", "-", "-"]
    assert one(spark, C.mentions(F.col("t"), RULES), *t)[:4] == [["first", "second"], ["third"], [], []]


def test_region_scores(spark):
    got = one(spark, C.region_scores([(F.col("t"), 5), (F.lit("eps gamma"), 1)], RULES), "alphabet", "xalpha epsilon", "")
    assert [[(r.name, r.score) for r in x] for x in got] == [[("first", 5), ("second", 1), ("third", 1)], [("second", 1), ("third", 1)], [("second", 1), ("third", 1)]]


def test_light_language(spark):
    t = ("Bakan dolar dedi", "ağ", "the market", "one two three four five six seven eight", "short text", "", None)
    assert one(spark, C.light_language(F.col("t")), *t) == ["tr", "tr", "en", "en", "unknown", "unknown", "unknown"]


def plain_bullets(bullets):
    """The rule said plainly, over texts of letters, digits and spaces."""
    kept = []
    for b in (x.rstrip(".!?…").strip() for x in bullets):
        words = b.lower().split()
        if len(b) <= 1 or len(words) < 3 and not any(c.isdigit() for c in b):
            continue
        own = {w for w in words if len(w) > 2}
        for k, other in enumerate(kept):
            theirs = {w for w in other.lower().split() if len(w) > 2}
            if b.lower() == other.lower() or own and theirs and len(own & theirs) / min(len(own), len(theirs)) >= 0.62:
                if len(b) > len(other):
                    kept[k] = b
                break
        else:
            kept.append(b)
    return kept


def test_distinct_bullets(spark):
    cases = [
        ["red green blue cat.", "red green blue", "one two", "room 5", "red green blue cat dog!", "four other words here"],
        ["Red Green Blue", "red green blue", "", "a", "green blue yellow sky", "yellow sky is up there"],
        [],
    ]
    d = spark.createDataFrame(list(enumerate(cases)), "i int, b array<string>")
    got = [r.v for r in d.select("i", X.distinct_bullets(F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [plain_bullets(c) for c in cases]
    assert spark.range(1).select(X.distinct_bullets(F.lit(None).cast("array<string>")).alias("v")).first().v is None
