"""Text rules as Column functions; built-ins only, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and their plain forms; one table for upper and lower case.
MARKED = "ÇĞİIÖŞÜÂÎÛçğıöşüâîûÀÁÄÈÉÊËÌÍÏÑÒÓÔÙÚàáäèéêëìíïñòóôùúß"
TURKISH_LOWER_FROM, TURKISH_LOWER_TO = "İI", "iı"
FOLD_FROM = "çğıöşüâîûàáäèéêëìíïñòóôùú"
FOLD_TO = "cgiosuaiuaaaeeeeiiinooouu"
#: The edge of a word of a-z, digits and underscores, whatever other letters stand there (Java's is one of all letters); white space of SQL, without the vertical tab.
EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
SPACE = r"[\t\n\f\r ]"
# Words that searches leave out.
SEARCH_STOP = ["ve", "veya", "ile", "bir", "bu", "şu", "su", "da", "de", "için", "icin", "olan", "olarak", "son", "yeni", "haber", "the", "and", "or", "for", "of", "in", "on", "to", "a", "an"]
# Words that the BM25 index leaves out.
BM25_STOP = ["ve", "veya", "ile", "bir", "bu", "şu", "o", "da", "de", "mi", "mı", "için", "olarak", "olan", "gibi", "çok", "daha", "sonra"]
# Suffixes in the order in which the search stemmer tries them, in plain letters.
SEARCH_SUFFIXES = [
    "lerinden", "larindan", "lerin", "larin", "lari", "leri", "lerde", "larda",
    "inden", "dan", "den", "dir", "dur", "lar", "ler", "nin", "nun", "in", "un", "de", "da", "e", "a",
]
# Openings that titles drop.
TITLE_OPENINGS = ["son dakika", "breaking news", "canlı", "özel haber"]
# Markers that story titles drop, and names of the central bank in their common form, in order.
STORY_MARKERS = ["son dakika", "breaking", "özel haber", "ozel haber", "canlı", "canli", "video", "foto galeri"]
STORY_ALIASES = {"tcmb": "merkez bankasi", "merkezden": "merkez bankasi", "merkez bankasindan": "merkez bankasi", "piyasalarin bekledigi": "merkez bankasi faiz", "piyasaların beklediği": "merkez bankasi faiz"}
# Words of titles on interest rates; three of them in a pair of titles tie it.
FINANCE_HINTS = ["faiz", "merkez", "bankasi", "karar", "tcmb", "piyasa"]
# Suffixes of the stemmers of related news, of stories and of comparisons.
RELATED_SUFFIXES = [
    "ından", "inden", "undan", "ünden", "ndan", "nden", "ının", "inin", "unun", "ünün", "nın", "nin", "nun", "nün",
    "ında", "inde", "unda", "ünde", "nda", "nde", "ları", "leri", "lar", "ler", "yla", "yle", "la", "le",
    "dan", "den", "tan", "ten", "da", "de", "ta", "te", "ya", "ye", "na", "ne", "yı", "yi", "yu", "yü",
    "ın", "in", "un", "ün", "ca", "ce", "ça", "çe",
]
STORY_SUFFIXES = [
    "ndan", "nden", "ından", "inden", "undan", "ünden", "nın", "nin", "nun", "nün", "ının", "inin", "unun", "ünün",
    "dan", "den", "tan", "ten", "nda", "nde", "ında", "inde", "unda", "ünde", "da", "de", "ta", "te", "ya", "ye", "na", "ne",
    "yla", "yle", "la", "le", "yı", "yi", "yu", "yü", "ın", "in", "un", "ün", "lar", "ler", "ları", "leri",
    "ca", "ce", "ça", "çe", "a", "e", "ı", "i", "u", "ü",
]
COMPARISON_SUFFIXES = [
    "nın", "nin", "nun", "nün", "dan", "den", "tan", "ten", "da", "de", "ta", "te", "lar", "ler", "ları", "leri",
    "ın", "in", "un", "ün", "yı", "yi", "yu", "yü", "ı", "i", "u", "ü",
]
# Url parameters that only track readers.
TRACKING = ["fbclid", "gclid", "dclid", "igshid", "mc_cid", "mc_eid", "yclid", "msclkid", "spm", "utm", "ref", "ref_src", "rss", "output"]


def lower_tr(x: Column) -> Column:
    """Lower case by Turkish rules: I becomes dotless."""
    for marked, plain in zip(TURKISH_LOWER_FROM, TURKISH_LOWER_TO, strict=True):
        x = F.replace(x, F.lit(marked), F.lit(plain))
    return F.lower(x)


def search_normal(x: Column) -> Column:
    """The search form: lower case, apostrophes dropped, marks folded, only a-z, digits and hyphens kept."""
    t = F.translate(F.regexp_replace(lower_tr(F.coalesce(x, F.lit(""))), "[’']", ""), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s-]", " "), r"\s+", " "))


def vector_normal(x: Column) -> Column:
    """The vector form: markup dropped, lower case, letters and numbers of any script kept."""
    t = lower_tr(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def dedupe_normal(x: Column) -> Column:
    """The form in which articles are compared."""
    t = lower_tr(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]*>", " "))
    # letters in lower case; a class that mixes plain and marked ones takes Java ten times as long
    t = F.regexp_replace(t, r"[^0-9a-z\x80-\x{10FFFF}]+|[\x80-\x{10FFFF}&&[^çğıöşüâîû]]+", " ")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def title_normal(x: Column) -> Column:
    """The comparison form of a title, without its openings."""
    return F.trim(F.regexp_replace(dedupe_normal(x), "^(" + "|".join(TITLE_OPENINGS) + ") ", ""))


def event_normal(x: Column) -> Column:
    """Lower case, marks folded, noise words of event titles dropped."""
    t = F.translate(F.lower(F.translate(F.coalesce(x, F.lit("")), "İ", "i")), FOLD_FROM, FOLD_TO)
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", " "), r"\b(bilet|ticket|etkinlik|event|konser|concert)\b", " ")
    return F.trim(F.regexp_replace(t, " +", " "))


def words_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def search_stem(w: Column) -> Column:
    """The first suffix in list order that leaves more than three letters is cut."""
    out = w
    for s in reversed(SEARCH_SUFFIXES):
        out = F.when(w.endswith(s) & (F.length(w) > len(s) + 3), F.substring(w, F.lit(1), F.length(w) - len(s))).otherwise(out)
    return out


def search_tokens(x: Column, distinct: bool = False) -> Column:
    """Stems of the search form; with distinct, each word is stemmed once, for uses that only ask what is there."""
    own = F.split(search_normal(x), " ")
    stems = F.transform(F.array_distinct(own) if distinct else own, search_stem)
    return F.filter(stems, lambda w: (F.length(w) >= 2) & ~w.isin(SEARCH_STOP))


def stem(w: Column, suffixes: list[str]) -> Column:
    """The longest suffix that leaves three letters is cut."""
    return F.regexp_replace(w, f"^(.{{3,}}?)(?:{'|'.join(suffixes)})$", "$1")


def plain_words(x: Column) -> Column:
    """The words of a text in lower case as they stand between spaces."""
    return F.filter(F.split(F.lower(F.translate(F.coalesce(x, F.lit("")), "İ", "i")), r"\s+"), lambda w: w != "")


def related_stem(w: Column) -> Column:
    return stem(F.split(w, "['‘’]")[0], RELATED_SUFFIXES)


def story_stem(w: Column) -> Column:
    """What stands before an apostrophe; else the word without its suffix."""
    return F.when(w.rlike("['‘’]"), F.split(w, "['‘’]")[0]).otherwise(stem(w, STORY_SUFFIXES))


def comparison_stem(w: Column) -> Column:
    """Before an apostrophe, marks folded, without suffix; marked suffixes can't fit there."""
    return stem(search_normal(F.split(w, "['’]")[0]), COMPARISON_SUFFIXES)


def story_title(x: Column) -> Column:
    """A title without punctuation and markers, the central bank under one name."""
    t = F.regexp_replace(F.regexp_replace(lower_tr(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " ")
    t = F.trim(F.regexp_replace(F.concat(F.lit(" "), F.trim(t), F.lit(" ")), f" (?:(?:{'|'.join(STORY_MARKERS)}) )+", " "))
    for name, common in STORY_ALIASES.items():
        t = F.replace(t, F.lit(name), F.lit(common))
    return t


def dedupe_tokens(x: Column) -> Column:
    return F.filter(F.split(dedupe_normal(x), " "), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]+$"))


def bm25_tokens(x: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " "), lambda w: (F.length(w) >= 2) & ~w.isin(BM25_STOP))


def once(value: Column, body) -> Column:
    """body(value) with value computed once a row; inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def word_shingles(tokens: Column, size: int = 3) -> Column:
    """Distinct runs of words; the distinct words where there are fewer."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        own = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), " "))
        return F.when(n < size, F.array_distinct(t)).otherwise(F.array_distinct(own))

    return once(tokens, runs)


def char_shingles(x: Column, size: int = 5) -> Column:
    """Distinct runs of characters of the text in lower case with single spaces."""

    def runs(t: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), ""))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(own))

    # characters once, as finding the i-th one of a text takes time in proportion to i
    return once(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " ")), ""), lambda c: c != ""), runs)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, no fragment, no trailing slashes, no tracking parameters, the rest sorted by name."""
    u = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(u, "^([a-zA-Z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    own = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).startswith("utm_") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    q = F.array_join(F.array_sort(own), "&")
    full = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when(scheme == "", F.substring_index(u, "#", 1)).otherwise(full)


def simple_url(url: Column) -> Column:
    """Always https and lower case, without www, m. hosts, fragment, query and trailing slash."""
    u = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "[?#].*$", "")
    u = F.regexp_replace(F.regexp_replace(u, r"^http://", "https://"), r"^https://(www\.|m\.)", "https://")
    return F.regexp_replace(u, "/+$", "")


def strip_html(x: Column) -> Column:
    """Visible text: scripts, styles and tags dropped, spaces squeezed."""
    t = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), f"{SPACE}+", " "))


def decode_entities(x: Column) -> Column:
    """The common named references; the ampersand last."""
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(ch))
    return x


def sentences(x: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(x, F.lit("")), f"{SPACE}+", " "), r"(?<=[.!?]) ")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def slug(x: Column) -> Column:
    t = F.translate(F.lower(F.translate(F.coalesce(x, F.lit("")), "İ", "i")), FOLD_FROM, FOLD_TO)
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def shorten(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, most - 1)), F.lit("…")))


def sanitize_query(x: Column, most: int = 150) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(x, r"[<>`$\\]", " "), r"\s+", " ")), 1, most)


def keyword_hit(normal: Column, keyword: str) -> Column:
    """A phrase anywhere, a single word only as a whole word."""
    return normal.contains(keyword) if " " in keyword else F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {keyword} ")


def trust_badge(trust: Column) -> Column:
    return F.when(trust >= 0.8, "high").when(trust >= 0.5, "medium").otherwise("low")


def distinct_bullets(bullets: Column, alike: float = 0.62) -> Column:
    """Bullets in order without those that say the same; of two alike ones the longer stands at the first one's place.

    Alike: equal normal forms, or that share of the shorter one's words of three letters and more. Bullets of under
    three words need a digit. One article's bullets are compared with each other, inside its row; null gives null.
    """
    entry = lambda b: once(dedupe_normal(b), lambda n: F.struct(b.alias("text"), n.alias("normal"), F.filter(F.array_distinct(F.split(n, " ")), lambda w: F.length(w) > 2).alias("words")))
    cut = F.transform(bullets, lambda b: entry(F.trim(F.regexp_replace(F.coalesce(b, F.lit("")), "[.!?…]+$", ""))))
    said = F.filter(cut, lambda e: (F.length(e["normal"]) > 1) & ((F.size(F.split(e["normal"], " ")) >= 3) | e["normal"].rlike("[0-9]")))
    same = lambda x, e: (x["normal"] == e["normal"]) | ((F.size(x["words"]) > 0) & (F.size(e["words"]) > 0) & (F.size(F.array_intersect(x["words"], e["words"])) >= alike * F.least(F.size(x["words"]), F.size(e["words"]))))

    def add(kept: Column, e: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda x: same(x, e)), True)
        swapped = F.transform(kept, lambda x, i: F.when((i + 1 == at) & (F.length(e["text"]) > F.length(x["text"])), e).otherwise(x))
        return F.when(at == 0, F.array_append(kept, e)).otherwise(swapped)

    kind = "array<struct<text:string,normal:string,words:array<string>>>"
    return F.transform(F.aggregate(said, F.array().cast(kind), lambda kept, e: add(kept, e).cast(kind)), lambda e: e["text"])
