"""Keyword classification, language detection, moderation and label governance."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as X

Rules = dict[str, dict[str, float]]


def parse_rules(text: str) -> Rules:
    """Rules from lines ``Category: word weight, two words weight``."""
    out: Rules = {}
    for line in filter(None, map(str.strip, text.splitlines())):
        name, _, rest = line.partition(":")
        out[name] = {w.rpartition(" ")[0].strip(): float(w.rpartition(" ")[2]) for w in rest.split(",")}
    return out


def scores(normal: Column, rules: Rules) -> dict[str, tuple[Column, Column]]:
    """Per category: the summed weights of its keywords that a normal text has, in hundredths, and their number."""
    out = {}
    for name, words in rules.items():
        hits = [(X.keyword_hit(normal, k), w) for k, w in words.items()]
        out[name] = (sum((F.when(h, round(w * 100)).otherwise(0) for h, w in hits), F.lit(0)), sum((h.cast("int") for h, _ in hits), F.lit(0)))
    return out


def classify(docs: DataFrame, rules: Rules, other: str = "Diğer", capped: tuple[str, float, float] | None = ("Siyaset", 2.8, 0.74), contested: tuple[str, float, float] | None = ("Gündem", 0.85, 0.78)) -> DataFrame:
    """(id, category, confidence) of docs (id, normal): best category by keyword weight.

    confidence = 0.45 + min(.3, score / 12) + min(.2, margin / 7) + min(.08, .015 * hits), at most 0.98. A capped
    category needs a score, a contested one a margin, to pass its bound. Ties go to the earlier category.
    """
    table = scores(F.col("normal"), rules)
    rows = F.array(*(F.struct((-s).alias("neg"), F.lit(i).alias("i"), h.alias("hits"), F.lit(name).alias("name")) for i, (name, (s, h)) in enumerate(table.items())))
    d = docs.select("id", F.array_sort(rows).alias("r"))
    best, second = -F.col("r")[0]["neg"] / 100, -F.col("r")[1]["neg"] / 100
    name = F.col("r")[0]["name"]
    conf = 0.45 + F.least(F.lit(0.3), best / 12) + F.least(F.lit(0.2), (best - second) / 7) + F.least(F.lit(0.08), F.col("r")[0]["hits"] * 0.015)
    if capped:
        conf = F.when((name == capped[0]) & (best < capped[1]), F.least(conf, F.lit(capped[2]))).otherwise(conf)
    if contested:
        conf = F.when((name == contested[0]) & (second >= best * contested[1]), F.least(conf, F.lit(contested[2]))).otherwise(conf)
    none = best <= 0
    return d.select("id", F.when(none, other).otherwise(name).alias("category"), F.when(none, 0.0).otherwise(F.round(F.least(F.lit(0.98), conf), 4)).alias("confidence"))


def profile_cosines(docs: DataFrame, rules: Rules) -> DataFrame:
    """(id, category, confidence) of docs (id, tokens): the category whose keywords' words are closest by cosine.

    confidence = .35 + .65 * cosine + .30 * lead over the next one, at most .91; none from a cosine of .025 down.
    Ties go to the earlier category.
    """
    profiles = {name: Counter(w for k in words for w in k.split()) for name, words in rules.items()}
    tf = docs.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
    value = lambda p: sum((F.when(F.col("token") == w, n).otherwise(0) for w, n in p.items()), F.lit(0))
    d = tf.groupBy("id").agg(F.sum(F.col("tf") * F.col("tf")).alias("square"), *(F.sum(F.col("tf") * value(p)).alias(f"dot{i}") for i, p in enumerate(profiles.values())))
    near = lambda i, p: F.col(f"dot{i}") / (F.sqrt("square") * math.sqrt(sum(n * n for n in p.values())))
    rows = F.array(*(F.struct((-near(i, p)).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, p) in enumerate(profiles.items())))
    d = d.select("id", F.array_sort(rows).alias("r"))
    best, second = -F.col("r")[0]["neg"], -F.col("r")[1]["neg"]
    conf = F.round(F.least(F.lit(0.91), 0.35 + best * 0.65 + (best - second) * 0.30), 4)
    return d.select("id", F.when(best > 0.025, F.col("r")[0]["name"]).otherwise("Diğer").alias("category"), F.when(best > 0.025, conf).otherwise(0.0).alias("confidence"))


def arbitrate(docs: DataFrame, by_rule: DataFrame, by_profile: DataFrame, reliable: float = 0.85, least: float = 0.55, shortest: int = 24) -> DataFrame:
    """(id, category, confidence, origin) of docs (id, length) from two classifiers' results.

    A reliable rule wins, else the more confident of both, the profile where equal; below ``least`` and for texts
    shorter than ``shortest`` the category is Diğer.
    """
    rule = by_rule.select("id", F.col("category").alias("rc"), F.col("confidence").alias("rule"))
    profile = by_profile.select("id", F.col("category").alias("pc"), F.col("confidence").alias("own"))
    d = docs.join(rule, "id", "left").join(profile, "id", "left").fillna({"rule": 0.0, "own": 0.0})
    short, sure = F.col("length") < shortest, F.col("rule") >= reliable
    best = F.greatest("rule", "own")
    category = F.when(short, "Diğer").when(sure, F.col("rc")).when(best < least, "Diğer").when(F.col("own") >= F.col("rule"), F.col("pc")).otherwise(F.col("rc"))
    conf = F.when(short, F.when(F.col("length") > 0, 0.18).otherwise(0.0)).when(sure, F.col("rule")).otherwise(F.least(F.lit(0.98), best))
    origin = F.when(short | (~sure & (best < least)), "fallback").when(sure | (F.col("own") < F.col("rule")), "keyword").otherwise("ml")
    return d.select("id", category.alias("category"), conf.alias("confidence"), origin.alias("origin"))


def counted_rules(docs: DataFrame, rules: Rules, most: int = 3, least: int = 2) -> DataFrame:
    """(id, category, place, confidence) of docs (id, normal): the categories with most keyword hits, repeats counted.

    confidence = .45 + .08 * hits + min(.12, .02 * keywords found), at most .75. Ties go to the earlier category.
    """
    n = F.col("normal")
    count = lambda k: F.size(F.split(n, k)) - 1 if " " in k else F.size(F.filter(F.split(n, " "), lambda w: w == k))
    counts = {name: [count(k) for k in words] for name, words in rules.items()}
    hits = {name: sum(c, F.lit(0)) for name, c in counts.items()}
    terms = {name: sum((F.when(x > 0, 1).otherwise(0) for x in c), F.lit(0)) for name, c in counts.items()}
    rows = F.array(*(F.struct((-hits[k]).alias("neg"), F.lit(i).alias("i"), terms[k].alias("terms"), F.lit(k).alias("category")) for i, k in enumerate(rules)))
    found = F.slice(F.array_sort(F.filter(rows, lambda r: r["neg"] <= -least)), 1, most)
    d = docs.select("id", F.posexplode(found).alias("place", "r"))
    conf = F.least(F.lit(0.75), 0.45 - F.col("r.neg") * 0.08 + F.least(F.lit(0.12), F.col("r.terms") * 0.02))
    return d.select("id", "r.category", (F.col("place") + 1).alias("place"), F.round(conf, 4).alias("confidence"))


def label_scores(docs: DataFrame, rules: Rules, threshold: float = 0.56) -> DataFrame:
    """(id, label, score, assigned) per document and label, scores independent of each other.

    logit = -2.65 + .92 * weights + min(.35, .08 * hits) + min(.25, length / 700); a label is given from the
    threshold on if its weights reach 1.25, it has two hits, or its score is 0.72.
    """
    table = scores(F.col("normal"), rules)
    rows = F.array(*(F.struct(F.lit(name).alias("label"), (s / 100).alias("raw"), h.alias("hits")) for name, (s, h) in table.items()))
    d = docs.select("id", F.length("normal").alias("n"), F.explode(rows).alias("r")).select("id", "n", "r.*")
    p = F.round(S.sigmoid(-2.65 + F.col("raw") * 0.92 + F.least(F.lit(0.35), F.col("hits") * 0.08) + F.least(F.lit(0.25), F.col("n") / 700)), 4)
    d = d.withColumn("score", p)
    return d.select("id", "label", "score", ((F.col("score") >= threshold) & ((F.col("raw") >= 1.25) | (F.col("hits") >= 2) | (F.col("score") >= 0.72))).alias("assigned"))


def best_thresholds(scored: DataFrame, candidates: list[float]) -> DataFrame:
    """Per label the threshold with the highest F1, the first where equal; scored: label, score, actual."""
    d = scored.withColumn("threshold", F.explode(F.array(*(F.lit(c) for c in candidates))))
    hit = F.col("score") >= F.col("threshold")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    d = d.groupBy("label", "threshold").agg(count(hit & F.col("actual")).alias("tp"), count(hit & ~F.col("actual")).alias("fp"), count(~hit & F.col("actual")).alias("fn"))
    f1 = F.when(F.col("tp") > 0, F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 9)).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("f1"), "threshold"))
    return d.withColumn("f1", f1).withColumn("rank", rank).filter("rank = 1").select("label", "threshold", "f1")


# Hints of the language detector.
EN_HINTS = [" the ", " and ", " with ", " from ", " says ", " government ", " president ", " market "]
TR_HINTS = [" bir ", " ve ", " için ", " haber ", " türkiye ", " açıklama ", " son dakika ", " ekonomi "]


def language(text: Column, sample: int = 1200) -> Column:
    """Struct (lang, confidence): Arabic and Cyrillic by letters, Turkish by letters and words, English by words.

    Only the first ``sample`` characters are looked at, as the rule has it.
    """
    t = F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, sample)
    low = F.concat(F.lit(" "), X.lower_tr(t), F.lit(" "))
    tr, ar, cy = F.regexp_count(t, F.lit("[çğıİöşüÇĞÖŞÜ]")), F.regexp_count(t, F.lit("[؀-ۿ]")), F.regexp_count(t, F.lit("[Ѐ-ӿ]"))
    words = F.regexp_count(t, F.lit("[A-Za-zÇĞİÖŞÜçğıöşü]{2,}"))
    en_hits, tr_hits = (sum((low.contains(h).cast("int") for h in hints), F.lit(0)) for hints in (EN_HINTS, TR_HINTS))
    lang = F.when(F.length(t) < 20, "unknown").when(ar > 8, "ar").when(cy > 8, "ru").when((tr >= 2) | (tr_hits >= 2), "tr").when((en_hits >= 2) | ((words >= 8) & (tr == 0)), "en").otherwise("unknown")
    sure = F.when(F.length(t) < 20, 0.0).when(ar > 8, 0.94).when(cy > 8, 0.91).when((tr >= 2) | (tr_hits >= 2), F.least(F.lit(0.99), 0.82 + tr * 0.025 + tr_hits * 0.04)).when((en_hits >= 2) | ((words >= 8) & (tr == 0)), F.least(F.lit(0.96), 0.78 + en_hits * 0.05)).otherwise(0.55)
    return F.struct(F.when(sure >= 0.85, lang).otherwise("unknown").alias("lang"), F.round(sure, 3).alias("confidence"))


def moderation(text: Column, toxicity: Column, blocked: list[str]) -> Column:
    """REJECTED for blocked words or from 0.95, PENDING from 0.70, else APPROVED."""
    low = F.lower(F.coalesce(text, F.lit("")))
    bad = F.lit(False)
    for w in blocked:
        bad = bad | low.contains(w)
    return F.when(bad | (toxicity >= 0.95), "REJECTED").when(toxicity >= 0.7, "PENDING").otherwise("APPROVED")


Phrases = dict[str, list[str]]


def most_hits(normal: Column, rules: Phrases, none: str, least: float = 1, weak: frozenset[str] = frozenset()) -> Column:
    """The name with most of its phrases in a normal text, ties to the earlier name; ``none`` below ``least`` hits.

    A weak phrase counts a quarter, so hits are summed in hundredths.
    """
    hits = lambda words: sum((F.when(normal.contains(w), 25 if w in weak else 100).otherwise(0) for w in words), F.lit(0))
    best = F.array_min(F.array(*(F.struct((-hits(words)).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules.items()))))
    return F.when(-best["neg"] >= round(least * 100), best["name"]).otherwise(none)


def longest_phrase(text: Column, rules: Phrases, none: str) -> Column:
    """The name of the longest phrase that a lower-case text has; of equally long ones the earlier."""
    found = F
    for w, name in sorted(((w, name) for name, words in rules.items() for w in words), key=lambda p: -len(p[0])):
        found = found.when(text.contains(w), name)
    return found.otherwise(none)


def mentions(text: Column, rules: Phrases) -> Column:
    """The names of which a lower-case text has a phrase, in the rules' order; phrases of up to three letters as whole words only."""
    # the word first and then its edges: looking for edges everywhere takes ten times as long
    hit = lambda w: text.rlike(rf"{w}(?<![a-z0-9_]{w})(?![a-z0-9_])") if len(w) <= 3 else text.contains(w)
    return F.array_compact(F.array(*(F.when(sum((hit(w).cast("int") for w in words), F.lit(0)) > 0, name) for name, words in rules.items())))


def region_scores(fields: list[tuple[Column, int]], rules: Phrases) -> Column:
    """Per name, as array of (name, score): the weights of (normal text, weight) fields summed over its keywords found.

    A keyword is found as whole words, a single word of five letters and more also as a word's beginning. Highest score
    first, ties in the rules' order; names without a hit are left out.
    """
    end = lambda w: "" if len(w) >= 5 and " " not in w else " "
    score = lambda words: sum((F.when(F.concat(F.lit(" "), f, F.lit(" ")).contains(f" {w}{end(w)}"), weight).otherwise(0) for f, weight in fields for w in words), F.lit(0))
    rows = F.array(*(F.struct((-score(words)).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules.items())))
    return F.transform(F.filter(F.array_sort(rows), lambda r: r["neg"] < 0), lambda r: F.struct(r["name"].alias("name"), (-r["neg"]).alias("score")))


# Words that tell Turkish and English in the light detection.
LIGHT_TR = ["ve", "bir", "için", "türkiye", "açıklama", "son", "dakika", "bakan", "dolar"]
LIGHT_EN = ["the", "and", "for", "with", "from", "government", "market", "president", "company"]


def light_language(text: Column, fallback: str = "unknown") -> Column:
    """tr from a score of two on, marked letters counting two and hint words one; en from two hints or eight words without marked letters on."""
    normal = X.dedupe_normal(text)
    words = F.split(normal, " ")
    marked = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^çğıİöşüÇĞÖŞÜ]", ""))
    hints = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    turkish, english = marked * 2 + hints(LIGHT_TR) >= 2, (hints(LIGHT_EN) >= 2) | ((F.size(words) >= 8) & (marked == 0))
    return F.when(normal == "", fallback).when(turkish, "tr").when(english, "en").otherwise(fallback)
