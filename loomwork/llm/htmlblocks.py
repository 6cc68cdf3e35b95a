"""Blocks of text of an HTML page, each with the path of the elements that it stands in.

Only elements that shape a page are on a path: blocks, and inline elements whose class, id or role names a part of a
page. A component of a path is the tag with its class, id and role, digits as 0, such as `div.post-0`. html and body
are not on paths, so a page cut off or without them has the same paths as others of its host.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: Elements whose content is text to no reader, read up to their end tag.
_RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<({_RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL | re.IGNORECASE)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[^a-z]+")

BLOCKS = frozenset(
    "address article aside blockquote button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup legend li main menu nav noscript object ol optgroup option p "
    "pre section select summary svg table tbody td template tfoot th thead tr ul video audio".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BREAKS = frozenset(("br", "hr", "wbr"))
#: A start tag ends the open elements named here, up to the nearest list or table around it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
_HOLDS = frozenset("ul ol menu dl table select".split())
#: Components of a path at most; below, a path keeps its first ones and its last.
DEPTH = 64

#: Parts of a page that are not its article, by element, and by words of a class, id or role.
NOISE_TAGS = frozenset("aside audio button canvas dialog dir fieldset footer form head header menu nav noscript object optgroup option select svg template video".split())
NOISE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer disqus footer form gdpr header hidden login masthead menu modal "
    "nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription teaser toolbar tooltip topbar widget".split()
)
#: Of these, the ones that also turn an article element, or one around the article, into another part of the page.
_ARTICLE_NOISE = NOISE_WORDS & frozenset("ad ads advert advertisement comment comments promo promoted recommended related replies reply sponsored teaser".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(maxsize=65_536)
def component(tag: str, attributes: str) -> str:
    """The path component of an element."""
    found = [tag]
    for name, *values in _NAMED.findall(attributes):
        value, name = " ".join(values).lower(), name.lower()
        found += sorted(value.split()) if name != "hidden" else ["hidden"]
    return _DIGITS.sub("0", ".".join(found).replace("/", "_"))


@lru_cache(maxsize=65_536)
def words_of(component_: str) -> tuple[str, frozenset[str]]:
    tag, _, rest = component_.partition(".")
    return tag, frozenset(_WORDS.split(rest)) - {""}


@lru_cache(maxsize=65_536)
def level(path: str) -> int:
    """0: in an article; 1: in an element named as main content; 2: elsewhere; 3: in another part of the page."""
    out, parts = 2, path.split("/")
    for k, part in enumerate(parts):
        tag, words = words_of(part)
        inside = out < 2
        if tag == "article":
            if words & _ARTICLE_NOISE:
                return 3
            out = 0
            continue
        heads = any(words_of(x)[0] in _HEADINGS for x in parts[k + 1 :]) or tag in _HEADINGS
        if inside and heads and (tag in ("header", "hgroup") or words & NOISE_WORDS <= {"header"}):
            continue  # the article's own headline
        if tag in NOISE_TAGS or words & (NOISE_WORDS if tag != "main" else frozenset()):
            return 3
        if out == 2 and (tag == "main" or words & MAIN_WORDS):
            out = 1
    return out


@dataclass
class Page:
    """blocks: (path, text, characters in links) in order; counts: elements by path; pairs: paths of two neighbours."""

    blocks: list[tuple[str, str, int]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)
    pairs: set[tuple[str, str]] = field(default_factory=set)


def parse(html: str | None) -> Page:
    """Tags that are never closed end with the element around them; end tags of nothing open are skipped."""
    page, html = Page(), html or ""
    blocks, counts, pairs = page.blocks, page.counts, page.pairs
    tags: list[str] = []  # of the open elements, with their paths and last children
    paths, last = [""], [""]
    buffer: list[str] = []
    linked, link_depth, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            text = " ".join((unescape(text) if "&" in text else text).split())
            if text:
                blocks.append((paths[-1], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal link_depth
        flush()
        del tags[depth:], paths[depth + 1 :], last[depth + 1 :]
        if link_depth > depth + 1:
            link_depth = 0

    for m in _TAG.finditer(html):
        start = m.start()
        if start > at:
            piece = html[at:start]
            buffer.append(piece)
            if link_depth:
                linked += len(piece.strip())
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "a":
                link_depth = 0
            elif tag in tags:
                depth = len(tags) - 1
                while tags[depth] != tag:
                    depth -= 1
                close(depth)
            elif tag == "head":
                close(0)
            continue
        if tag == "a":
            link_depth = len(tags) + 1
            continue
        if tag in _VOID:
            if tag in _BREAKS:
                buffer.append(" ")
            continue
        attributes = m.group(4)
        if tag not in BLOCKS:
            if tag == "body":
                close(0)
            if tag in ("html", "body") or not attributes or attributes.endswith("/"):
                continue
            own = component(tag, attributes)
            if not words_of(own)[1] & NOISE_WORDS:
                continue
        else:
            own = component(tag, attributes) if attributes else tag
        flush()
        if tags and tags[-1] == "p" and tag in BLOCKS:
            close(len(tags) - 1)
        ends = _ENDS.get(tag)
        if ends:
            depth = len(tags)
            while depth and tags[depth - 1] not in _HOLDS:
                depth -= 1
                if tags[depth] in ends and not any(t in ends for t in tags[:depth][-1:]):
                    close(depth)
                    break
        if len(tags) < DEPTH:
            path = f"{paths[-1]}/{own}" if tags else own
        else:
            path = paths[-1] if level(paths[-1]) == 3 else f"{paths[DEPTH - 1]}/{own}"
        counts[path] = counts.get(path, 0) + 1
        pairs.add((last[-1], path))
        last[-1] = path
        if attributes.endswith("/") and tag not in ("p", "div", "li"):
            continue
        tags.append(tag)
        paths.append(path)
        last.append("")
    if at < len(html):
        buffer.append(html[at:])
    flush()
    return page
