"""The text rules of ``functions.text`` as DuckDB SQL expressions, for the stated results."""

from __future__ import annotations

from ..functions import text as X


def q(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def lower_tr(x: str) -> str:
    return f"lower(translate({x}, 'İI', 'iı'))"


def search_normal(x: str) -> str:
    low = lower_tr(f"coalesce({x}, '')")
    t = f"translate(regexp_replace({low}, '[’'']', '', 'g'), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
    return f"trim(regexp_replace(regexp_replace({t}, '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def vector_normal(x: str) -> str:
    t = lower_tr(f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def dedupe_normal(x: str) -> str:
    t = lower_tr(f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')")
    return f"trim(regexp_replace({t}, '[^0-9a-zA-ZçğıöşüÇĞİÖŞÜâîûÂÎÛ]+', ' ', 'g'))"


def title_normal(x: str) -> str:
    return f"trim(regexp_replace({dedupe_normal(x)}, '^({'|'.join(X.TITLE_OPENINGS)}) ', ''))"


def event_normal(x: str) -> str:
    t = f"translate(lower(translate(coalesce({x}, ''), 'İ', 'i')), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
    t = f"regexp_replace(regexp_replace({t}, '[^a-z0-9]+', ' ', 'g'), '\\b(bilet|ticket|etkinlik|event|konser|concert)\\b', ' ', 'g')"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def search_stem(w: str) -> str:
    whens = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) > {len(s) + 3} THEN substr({w}, 1, length({w}) - {len(s)})" for s in X.SEARCH_SUFFIXES)
    return f"CASE {whens} ELSE {w} END"


def search_tokens(x: str) -> str:
    return f"list_filter(list_transform(string_split({search_normal(x)}, ' '), lambda w: {search_stem('w')}), lambda w: length(w) >= 2 AND w NOT IN {q(X.SEARCH_STOP)})"


def stem(w: str, suffixes) -> str:
    return f"regexp_replace({w}, '^(.{{3,}}?)(?:{'|'.join(suffixes)})$', '\\1')"


def plain_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower(translate(coalesce({x}, ''), 'İ', 'i')), '\\s+'), lambda w: w <> '')"


def story_title(x: str) -> str:
    t = f"regexp_replace(regexp_replace({lower_tr(f"coalesce({x}, '')")}, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')"
    t = f"trim(regexp_replace(' ' || trim({t}) || ' ', ' (?:(?:{'|'.join(X.STORY_MARKERS)}) )+', ' ', 'g'))"
    for name, common in X.STORY_ALIASES.items():
        t = f"replace({t}, '{name}', '{common}')"
    return t


def dedupe_tokens(x: str) -> str:
    return f"list_filter(string_split({dedupe_normal(x)}, ' '), lambda w: length(w) > 1 OR regexp_matches(w, '^[0-9]+$'))"


def bm25_tokens(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN {q(X.BM25_STOP)})"


def word_shingles(tokens: str, size: int = 3) -> str:
    return (
        f"CASE WHEN len({tokens}) = 0 THEN [] WHEN len({tokens}) < {size} THEN list_distinct({tokens}) "
        f"ELSE list_distinct(list_transform(range(1, len({tokens}) - {size} + 2), lambda i: array_to_string({tokens}[i:i + {size - 1}], ' '))) END"
    )


def canonical_url(u: str) -> str:
    u = f"trim(coalesce({u}, ''))"
    scheme = f"lower(regexp_extract({u}, '^([a-zA-Z]+)://', 1))"
    host = f"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"
    path = f"regexp_replace(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"
    own = f"list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN {q(X.TRACKING)})"
    text = f"array_to_string(list_sort({own}), '&')"
    return f"CASE WHEN {scheme} = '' THEN split_part({u}, '#', 1) ELSE {scheme} || '://' || {host} || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || (CASE WHEN {text} = '' THEN '' ELSE '?' || {text} END) END"


def simple_url(u: str) -> str:
    u = f"regexp_replace(lower(trim(coalesce({u}, ''))), '[?#].*$', '')"
    u = f"regexp_replace(regexp_replace({u}, '^http://', 'https://'), '^https://(www\\.|m\\.)', 'https://')"
    return f"regexp_replace({u}, '/+$', '')"


def strip_html(x: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def decode_entities(x: str) -> str:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{ch}')"
    return x


def slug(x: str) -> str:
    t = f"translate(lower(translate(coalesce({x}, ''), 'İ', 'i')), '{X.FOLD_FROM}', '{X.FOLD_TO}')"
    return f"regexp_replace(regexp_replace({t}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
