"""Main text of web pages by consensus host paths.

Every page's containers are scored; the best one's path, as tags and generalised classes, is the page's vote for
its host. Votes are counted in Spark, and each page is extracted again from the container on its host's winning
path. A page without that path, or with too little of its text there, is extracted from its own best container.

A page is scanned as a flat list of tags; text is never parsed into a tree of objects.

* Dropped anywhere: scripts, styles, menus, footers, sidebars, embedded objects, comments of the markup, hidden elements,
  and elements one of whose classes, or whose id or role, says menu, advert, notice, sharing or reader comments. A class
  says so as a whole: by such a word alone, or beside words of layout only (``ad-box``, not ``ad-hoc-report``).
* Dropped where that loses no article: forms, headers, and elements named by words that also name contents (``discussion``,
  ``widget``). They stay if they hold most of the page's paragraphs, or, but for forms, stand inside the article or its
  container and consist of paragraphs. Headings are never dropped by name, inline elements not within an article.
* If that leaves no paragraph of a page that has some, the named element or form with most of them stays.
* Figure captions are text like other text.
* The score of a container is its share of the page's text outside of links. The best container is the article or
  main element with most of that text, else the lowest box that holds nearly all of it, and from which no paragraph
  of the box around it is left out.
* A "<" that opens no well-formed tag is text.
* Blocks end at block-level tags and line breaks. Character references are decoded, white space within a block
  becomes one space, blocks are trimmed, empty ones left out, and the rest joined by line ends.

Defined cases: null or empty html, or a page without text outside of dropped elements, gives an empty text.
Cut-off pages, unclosed and stray tags are read as far as they go. Repeated pages vote each; equal votes go to the
first path by name. A null url, or one without a host, votes under the empty host. Very long pages take memory in
proportion to the page. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, saved, unpacked

#: A comment, a declaration, or a tag with its attributes; quotes count only after an equals sign.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>?)",
    re.S,
)
_RAW = {x: re.compile(rf"</{x}\s*(?:>|\Z)", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")}
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")

_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_DROPPED = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "object", "menu", "dialog", "canvas", "audio", "video"}
#: Elements kept on the stack: those that can hold the main text, or are dropped whole.
_BOXES = {"html", "body", "main", "article", "section", "div", "td", "tr", "table", "tbody", "center", "header", "ul", "ol", "dl", "blockquote", "figure", "details"}
_BLOCKS = _BOXES | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "br", "hr", "th", "caption", "thead", "tfoot", "address", "summary", "fieldset", "legend", "figcaption"}
_ROOTS = {"html", "body"}
#: Elements whose text directly in a box makes the box itself part of the article.
_PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "caption", "figcaption", "summary"}
#: Elements that the next one of their kind ends.
_ENDED = {"p", "li", "dt", "dd"}
#: Tag names that prose after a "<" is told from.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "map", "mark", "math", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "picture", "option", "optgroup", "input", "output", "progress", "meter", "hgroup", "colgroup", "frame", "frameset"}
#: Words of classes and ids: these drop an element; these do unless it holds paragraphs of the article; these only tell of layout.
_BAD = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars menu menus nav navbar navigation"
    " breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer share sharing sharebar newsletter subscribe subscription signup login comment comments commentlist disqus respond".split()
)
_SOFT = set("header alert aside rail widget widgets social related recommended recommendations search tags reply replies discussion discussions thread threads reactions copyright skip promo promotion banner banners".split())
_LAYOUT = set(
    "area bar block body bottom box btn button buttons cell center col column container content cta floating fixed form global group holder horizontal icon icons inline inner item items label left link links list main"
    " mobile module outer page panel post posts article articles story stories primary region right row secondary section side site slot small sticky strip text top unit vertical wrap wrapper zone".split()
)
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|\d+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DEPTH = 12
#: Share of a page's text that its best container holds: any box, and an article or main element.
NEARLY, MOST = 0.98, 0.5
#: The host's path is used where it holds this share of the best container's text, or FEW if it has several blocks.
ENOUGH, FEW = 0.5, 0.15


#: Share of a page's paragraphs that keeps an element from being dropped, and of an element's text in the article that its paragraphs make up.
MAJORITY, PROSE = 0.5, 0.4


class _Lost:
    """A dropped element: where its tag stands, why it was dropped, and its text, also that outside of links, and in paragraphs."""

    __slots__ = ("at", "why", "article", "up", "text", "plain", "paragraphs")

    def __init__(self, at: int, why: str, article: bool, up: _Box):
        self.at, self.why, self.article, self.up, self.text, self.plain, self.paragraphs = at, why, article, up, 0, 0, 0


class _Box:
    __slots__ = ("tag", "path", "drop", "up", "good", "paragraphs")

    def __init__(self, tag: str, path: str, drop: bool, up: _Box | None):
        self.tag, self.path, self.drop, self.up = tag, path, drop, up
        self.good = self.paragraphs = 0  # characters directly in the box, outside of links; of these in paragraphs


def _attributes(raw: str) -> tuple[str, str, bool]:
    """Classes, what tells of the element's use (classes and id), and whether it is hidden or has a role that is dropped."""
    if not raw or "=" not in raw and "hidden" not in raw:
        return "", "", False
    classes, about, off = "", "", False
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class":
            classes = value
            about += " " + value
        elif name == "id":
            about += " " + value
        elif name == "role":
            off |= value.lower() in _BAD_ROLES
        elif name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _UNSEEN.search(value):
            off = True
    return classes, about, off


def _named(about: str) -> str:
    """What the classes and the id say of an element: "bad", "soft" or nothing."""
    found = ""
    for name in about.split():
        parts = {x.lower() for x in _PARTS.split(name) if x}
        if parts and parts <= _BAD | _SOFT | _LAYOUT:
            if parts & _BAD:
                return "bad"
            if parts & _SOFT:
                found = "soft"
    return found


def _is_tag(m: re.Match, end: int) -> bool:
    """Whether what looks like a tag is one, and not prose after a "<"."""
    if m[4]:
        return True
    tag, rest = m[2].lower(), m[3].strip()
    known = tag in _BLOCKS or tag in _DROPPED or tag in _VOID or tag in _RAW or tag in _INLINE
    return known and ("=" in rest or not rest and tag in _BLOCKS or m.end() == end and len(rest.split()) < 2)


def _general(tag: str, classes: str) -> str:
    """A path step: the tag with its classes in order of name, numbers made alike."""
    return ".".join([tag, *sorted({_DIGITS.sub("0", c.lower()) for c in classes.split()})])


def scan(page: str, want: str | None = None, spared: frozenset[int] = frozenset()) -> tuple[list[_Box], list[str], list[_Lost]]:
    """All boxes of a page in order of their start, the blocks of the text inside boxes on path ``want``, and what was dropped.

    The first box is the page itself, with an empty path. spared: where elements begin that aren't dropped.
    """
    root = _Box("", "", False, None)
    stack, boxes, blocks = [root], [root], []
    texts: list[str] = []
    inside = int(want == "")  # how many open boxes are on the wanted path
    drops = 0  # how many open boxes are dropped
    losses: list[_Lost] = []
    ignored: list[str] = []  # a dropped element that is no box, and what is open inside it
    link, kind = False, ""
    at, end = 0, len(page)

    def text(lo: int, hi: int) -> None:
        if hi > lo and (drops or ignored):
            n = len(page[lo:hi].strip())
            losses[-1].text += n
            losses[-1].plain += 0 if link else n
            losses[-1].paragraphs += n if kind in _PARAGRAPHS and not link else 0
        elif hi > lo:
            raw = page[lo:hi]
            if inside:
                texts.append(raw)
            n = len(raw.strip())
            if n and not link:
                box = stack[-1]
                box.good += n
                if kind in _PARAGRAPHS:
                    box.paragraphs += n

    def block() -> None:
        if texts:
            line = " ".join(entities.unescape("".join(texts)).split())
            texts.clear()
            if line:
                blocks.append(line)

    from_ = 0
    while at < end:
        m = _TAG.search(page, from_)
        if not m:
            text(at, end)
            break
        tag = m[2]
        if tag is not None and not _is_tag(m, end):
            from_ = m.start() + 1
            continue
        text(at, m.start())
        at = from_ = m.end()
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a" or tag in _BLOCKS:
                link = False
            if ignored:
                if tag in _BLOCKS:
                    kind = ""
                if tag in ignored:
                    del ignored[len(ignored) - 1 - ignored[::-1].index(tag) :]
                    continue
                if tag not in _BOXES or not any(x.tag == tag for x in stack):
                    continue
                ignored.clear()  # the box around it ends, so it ends too
            if tag in _BLOCKS:
                block()
                kind = ""
            if tag in _BOXES or tag in _DROPPED:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        for x in stack[k:]:
                            drops -= x.drop
                            inside -= bool(want) and x.path == want and not x.drop
                        del stack[k:]
                        break
            continue
        if tag in _RAW:
            if not ignored and tag in _BLOCKS:
                block()
            close = _RAW[tag].search(page, at)
            at = from_ = close.end() if close else end
            continue
        if ignored and len(ignored) == 1 and ignored[0] in _ENDED and (tag == ignored[0] or ignored[0] == "p" and tag in _BLOCKS and tag != "br"):
            ignored.clear()
        if ignored:
            if tag in _BLOCKS and tag not in _VOID:
                kind = tag
            link |= tag == "a"
            if (tag == ignored[-1] or tag in _BOXES) and not m[3].endswith("/"):
                ignored.append(tag)
            continue
        if tag in _BLOCKS:
            block()
            kind = tag if tag not in _VOID else kind
        if tag == "a":
            link = True
        if tag in _VOID or tag not in _BOXES and tag not in _DROPPED and not m[3]:
            continue
        classes, about, off = _attributes(m[3])
        article = any(x.tag in ("article", "main") for x in stack)
        said = _named(about) if tag not in _ROOTS and tag not in ("article", "main") and tag not in _HEADINGS and not (article and tag in _INLINE) else ""
        why = "tag" if tag in _DROPPED and tag != "form" else "bad" if off or said == "bad" else "form" if tag == "form" else "soft" if said or tag == "header" and not article else ""
        bad = bool(why) and (why == "tag" or m.start() not in spared)
        if bad and not drops:
            losses.append(_Lost(m.start(), why, article, stack[-1]))
        if tag in _BOXES:
            if len(stack) > 400:  # deeper boxes count as their parent
                continue
            box = _Box(tag, "/".join([*stack[-1].path.split("/")[-DEPTH + 1 :], _general(tag, classes)]).lstrip("/"), bad, stack[-1])
            stack.append(box)
            boxes.append(box)
            drops += bad
            inside += bool(want) and box.path == want and not bad
        elif bad and not m[3].rstrip().endswith("/"):
            block()
            ignored.append(tag)
    block()
    return boxes, blocks, losses


def _held(boxes: list[_Box]) -> tuple[dict[str, int], dict[str, _Box], dict[str, set[str]]]:
    """Per path: the text its boxes hold with all inside them, its first box, and the paths of the boxes in them."""
    whole = {id(b): b.good for b in boxes}
    for b in reversed(boxes):
        if b.up is not None:
            whole[id(b.up)] += whole[id(b)]
    held: dict[str, int] = {}
    first: dict[str, _Box] = {}
    below: dict[str, set[str]] = {}
    for b in boxes:
        if b.drop:
            continue
        if b.path not in first:
            first[b.path] = _Box(b.tag, b.path, False, b.up)
        first[b.path].paragraphs += b.paragraphs
        up, same = b.up, False
        if b.path.count("/") == DEPTH - 1:  # only paths cut off at the top can recur inside themselves
            while up is not None and not same:
                same, up = up.path == b.path, up.up
        if not same:
            held[b.path] = held.get(b.path, 0) + whole[id(b)]
            if b.up is not None:
                below.setdefault(b.up.path, set()).add(b.path)
    return held, first, below


def _best(boxes: list[_Box]) -> tuple[str | None, dict[str, int]]:
    held, first, below = _held(boxes)
    total = held.get("", 0)
    if not total:
        return None, held
    named = [p for p, n in held.items() if first[p].tag in ("article", "main") and n >= MOST * total]
    at = max(named, key=lambda p: (p.count("/"), held[p], p)) if named else ""
    while first[at].tag != "article":
        # a cut-off path can lead back to itself, so the way down is only to paths with less text or more steps
        down = [p for p in below.get(at, ()) if held[p] >= NEARLY * held[at] and (held[p] < held[at] or p.count("/") > at.count("/") or not at)]
        if not down or first[at].paragraphs and first[at].tag not in _ROOTS:
            break
        at = max(down, key=lambda p: (held[p], p))
    return at, held


def _within(x: _Lost, path: str | None) -> bool:
    box = x.up
    while box is not None and box.path != path:
        box = box.up
    return box is not None


def _understood(page: str) -> tuple[str | None, dict[str, int], frozenset[int]]:
    """The best container's path, the text per path, and the elements that are spared."""
    spared: frozenset[int] = frozenset()
    while True:
        boxes, _, lost = scan(page, None, spared)
        own, held = _best(boxes)
        kept = sum(b.paragraphs for b in boxes if not b.drop)
        some = [x for x in lost if x.why != "tag"]
        written = kept or any(x.paragraphs for x in lost)  # whether the page has paragraphs at all
        if not written:
            kept = held.get("", 0)
        prose = {x.at: x.paragraphs if written else x.plain for x in some}
        soft = [x for x in some if x.why != "bad" and prose[x.at]]
        most = MAJORITY * (kept + sum(prose[x.at] for x in soft))
        more = {x.at for x in soft if prose[x.at] > most or x.why == "soft" and x.paragraphs >= max(1, PROSE * x.text) and (x.article or own is not None and _within(x, own))}
        if not more and not kept and (left := max(some, key=lambda x: prose[x.at], default=None)) and held.get("", 0) < (1 - NEARLY) * prose[left.at]:
            more = {left.at}
        if not more:
            return own, held, spared
        spared |= more


def best_path(page: str) -> tuple[str | None, float]:
    """The path of the page's best container (empty for the page itself), and the share of the page's text it holds."""
    path, held, _ = _understood(page)
    return (None, 0.0) if path is None else (path, held[path] / held[""])


def extract(page: str | None, path: str | None) -> str:
    """The text in the containers on this path, or in the page's best container if they have too little of it."""
    if not page:
        return ""
    path = path or None
    own, held, spared = _understood(page)
    if own is None:  # all text is in links, or there is none
        return "\n".join((path and scan(page, path, spared)[1]) or scan(page, "", spared)[1])
    share = held.get(path, 0) / held[own] if path else 0
    if share >= FEW:
        blocks = scan(page, path, spared)[1]
        if path == own or share >= ENOUGH or len(blocks) > 1:
            return "\n".join(blocks)
    return "\n".join(scan(page, own, spared)[1])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hosts, paths = [], []
        for host, page in zip(b.column("host"), b.column("html"), strict=True):
            path, _ = best_path(page.as_py() or "")
            if path:
                hosts.append(host.as_py())
                paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            texts = [extract(page.as_py(), path.as_py()) for page, path in zip(part.column("html"), part.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])


def _host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def winning_paths(df: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Per host the path with most votes, ties to the first by name: (host, path, votes). A written table."""
    votes = df.select(_host(url).alias("host"), F.col(html).alias("html")).mapInArrow(_vote, "host string, path string")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    best = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return saved(counts.withColumn("rank", best).filter("rank = 1").drop("rank"), "host-paths")


def main_text(df: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The carried columns with text and n_chars. paths: winners from earlier pages, else those of df."""
    carry = [c for c in df.columns if c != html] if carry is None else carry
    paths = winning_paths(df, url, html) if paths is None else paths
    rows = df.select(packed(carry), F.col(html).alias("html"), _host(url).alias("of"))
    d = rows.join(paths.select("host", "path"), F.col("of") == F.col("host"), "left").select("row", "html", "path")
    kinds = T.StructType([d.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return d.mapInArrow(_extract, kinds).select(*unpacked(carry, "text", "n_chars"))
