"""Scores and ladders as Column functions; every age is measured from an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds in hours and the score up to them; the last entry is for older or missing dates.
LADDERS = {
    "search": ([(1, 100), (6, 90), (24, 75), (72, 50), (168, 30)], 10, 10),
    "recommendation": ([(6, 100), (24, 80), (72, 55), (168, 30)], 10, 10),
    "feed": ([(6, 100), (24, 90), (72, 75), (168, 60), (720, 35)], 20, 45),
}


def hours_old(when: Column, as_of: Column) -> Column:
    """Hours since then, not less than 0; null where undated (greatest alone would skip the null)."""
    return F.when(when.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(when.cast("timestamp"))) / 3600e6))


def freshness(when: Column, as_of: Column, ladder: str) -> Column:
    """A freshness ladder by name: search, recommendation or feed."""
    steps, older, missing = LADDERS[ladder]
    h = hours_old(when, as_of)
    out = F.when(when.isNull(), missing)
    for most, score in steps:
        out = out.when(h <= most, score)
    return out.otherwise(older)


def decayed_views(views: Column, when: Column, as_of: Column) -> Column:
    """views * exp(-0.05 h); an undated article counts as a day old."""
    return views * F.exp(-0.05 * F.coalesce(hours_old(when, as_of), F.lit(24.0)))


def recency(when: Column, as_of: Column) -> Column:
    """exp(-0.05 h), 0.5 where undated."""
    return F.coalesce(F.exp(-0.05 * hours_old(when, as_of)), F.lit(0.5))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def popularity_log(views: Column) -> Column:
    return F.log10(1 + F.greatest(views, F.lit(0)).cast("double"))


def importance(sources: Column, keywords: Column, image: Column) -> Column:
    s = 0.35 + F.least(F.lit(0.25), sources * 0.03) + F.least(F.lit(0.2), keywords * 0.02) + F.when(image, 0.12).otherwise(0.0)
    return F.least(F.lit(0.99), s)


def article_quality(image: Column, trust: Column, summary: Column, title: Column, early: Column) -> Column:
    """Image 30, half the trust of 0-100, summary up to 25, title up to 15, early bonus up to 12."""
    return F.when(image, 30).otherwise(0) + trust / 2 + F.least(F.lit(25.0), F.length(summary) / 12) + F.least(F.lit(15.0), F.length(title) / 6) + F.least(F.lit(12.0), early)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def proximity(hours: Column, steps: list[tuple[float, float]], far: float = 0.0) -> Column:
    """A ladder over the distance of two dates."""
    out = F.when(hours.isNull(), far)
    for most, score in steps:
        out = out.when(hours <= most, score)
    return out.otherwise(far)


# Ladders over the hours between two dates; score up to them, beyond the last one, and where one is missing.
CLOSENESS = {
    "cluster": ([(12, 1.0), (24, 0.85), (72, 0.55), (168, 0.25)], 0.0, 0.35),
    "story": ([(1, 1.0), (3, 0.95), (6, 0.85), (12, 0.70), (24, 0.50)], 0.0, 0.35),
    "related": ([(2, 1.0), (6, 0.9), (12, 0.75), (24, 0.55), (48, 0.35), (72, 0.15)], 0.0, 0.3),
}


def closeness(hours: Column, ladder: str) -> Column:
    """How close two dates are by a named ladder: cluster, story or related."""
    steps, far, missing = CLOSENESS[ladder]
    return F.when(hours.isNull(), missing).otherwise(proximity(hours, steps, far))


def source_boost(haystack: Column, sources: list[tuple[str, str, list[str], bool, str]]) -> Column:
    """Boost of an article's normal text by a reader's sources (title, category, tags, favorite, trust), in their order.

    A title found adds 5 (favorite) or 3, category and tags 1.5 each; a source's trust then multiplies the sum so far. At most 8.
    """
    out = F.lit(0.0)
    for title, category, tags, favorite, trust in sources:
        found = F.lit(False)
        for t in tags:
            if len(t) > 2:
                found = found | haystack.contains(t)
        add = F.when(haystack.contains(title), 5.0 if favorite else 3.0).otherwise(0.0) + F.when(haystack.contains(category) if category != "genel" else F.lit(False), 1.5).otherwise(0.0) + F.when(found, 1.5).otherwise(0.0)
        out = (out + add) * {"low": 0.8, "high": 1.1}.get(trust, 1.0)
    return F.least(F.lit(8.0), out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def tokens_and_cost(text: Column, per_million: float) -> tuple[Column, Column]:
    """A quarter of the characters, rounded up, and their price."""
    n = F.ceil(F.length(text) / 4)
    return n, F.round(n * per_million / 1_000_000, 6)


def device(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)ipad|tablet"), "tablet").when(agent.rlike("(?i)mobi|android|iphone"), "mobile").otherwise("desktop")
