"""Main text of web pages by wrappers: union-free regular expressions that the pages of a host share.

The token streams of a host's pages are aligned element by element. What differs becomes an optional element (some
pages lack it), a repeated group (it occurs more than once, or in both orders), or a text slot (its texts differ);
texts that never differ stay literals of the template. Alignment only keeps sums, least and largest values, so that
it may go in any order: each batch aligns its pages, and Spark aligns the rest in one aggregation, which takes a host
with any share of the pages in parts first. The text of a page is read from the slots that hold the article.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import stored
from loomwork.llm.htmlblocks import level, parse, words_of
from loomwork.llm.urls import url_parts

#: What a row of an alignment is about: a host, an element, a text slot, a text of a slot, two neighbours.
HOST, ELEMENT, SLOT, TEXT, PAIR = range(5)
#: A text is a literal of the template if this many pages have it and none of the host's has another in its place.
LITERAL_PAGES = 10
#: A slot is a list of links if this part of its characters is in links; paragraphs and headings never are.
LINKED = 0.8
#: The element that holds this part of the text of its parent holds the article, where no element says that it does.
MOST_TEXT = 0.7
#: Distinct rows of an alignment that a batch holds at once.
HELD = 50_000

_ALIGNED = "host string, kind int, path string, other string, place int, pages long, low long, high long, chars long, linked long"


def _align(rows: dict, host: str, html: str | None) -> None:
    """Adds one page to rows: (host, kind, path, other, place) to [pages, low, high, chars, linked]."""
    page = parse(html)

    def add(key: tuple, low: int, high: int, chars: int = 0, linked: int = 0) -> None:
        old = rows.get(key)
        if old is None:
            rows[key] = [1, low, high, chars, linked]
        else:
            old[0] += 1
            old[1] = min(old[1], low)
            old[2] = max(old[2], high)
            old[3] += chars
            old[4] += linked

    add((host, HOST, "", "", 0), 0, 0)
    for path, n in page.counts.items():
        add((host, ELEMENT, path, "", 0), n, n)
    for a, b in page.pairs:
        add((host, PAIR, a, b, 0), 0, 0)
    slots: dict[str, list[int]] = {}
    for path, text, linked in page.blocks:
        slot = slots.setdefault(path, [0, 0, 0])
        mark = xxhash.xxh3_64_intdigest(text) - (1 << 63)
        add((host, TEXT, path, "", slot[0]), mark, mark)
        slot[0] += 1
        slot[1] += len(text)
        slot[2] += linked
    for path, (n, chars, linked) in slots.items():
        add((host, SLOT, path, "", 0), n, n, chars, linked)


def _expression(elements: dict[str, list], slots: set[str], pairs: list[tuple[str, str]], pages: int) -> str:
    """The wrapper as text: elements in order, ? after optional ones, + after repeated ones and groups."""
    children, follows = defaultdict(list), defaultdict(set)
    for path in elements:
        children[path.rpartition("/")[0]].append(path)
    for a, b in pairs:
        if a:
            follows[a].add(b)

    def reached(start: str) -> set[str]:
        seen, left = set(), [start]
        while left:
            for b in follows[left.pop()]:
                if b not in seen:
                    seen.add(b)
                    left.append(b)
        return seen

    def show(parent: str, n: int) -> str:
        own = sorted(children[parent])
        ahead = {c: reached(c) for c in own}
        groups = {tuple(d for d in own if d == c or (d in ahead[c] and c in ahead[d])) for c in own}
        out = "#" if parent in slots else ""
        for group in sorted(groups, key=lambda g: (-len(ahead[g[0]]), g)):
            items = []
            for c in group:
                tag = c.rpartition("/")[2]
                repeated = "+" if len(group) == 1 and (c in ahead[c] or elements[c][2] > 1) else ""
                items.append(f"<{tag}>{show(c, elements[c][0])}</{tag}>{repeated}" + ("?" if elements[c][0] < n or len(group) > 1 else ""))
            out += items[0] if len(items) == 1 else f"({''.join(items)})+"
        return out

    return show("", pages)


def _article(slots: dict[str, list]) -> str:
    """The path of the element that holds most text, where no element is named as the article or main content."""
    chars: dict[str, int] = defaultdict(int)
    for path, (_, _, _, n, _) in slots.items():
        if level(path) == 2:
            parts = path.split("/") if path else []
            for k in range(len(parts) + 1):
                chars["/".join(parts[:k])] += n
    at = ""
    while True:
        below = [p for p in chars if p and p.rpartition("/")[0] == at]
        most = max(below, key=lambda p: (chars[p], p), default="")
        if not most or chars[most] < MOST_TEXT * chars[at] or words_of(most.rpartition("/")[2])[0] in ("p", "h1", "h2", "h3", "ul", "ol", "table", "blockquote", "pre"):
            return at
        at = most


def _wrapper(rows: list[tuple]) -> tuple[int, str, str, list[str], list[str], list[int], list[int]]:
    """pages, expression, article, link slots, and path, place and count of literals, of the alignment of a host."""
    kinds: dict[int, dict] = {k: {} for k in range(5)}
    for kind, path, other, place, *values in rows:
        kinds[kind][path if kind in (ELEMENT, SLOT) else (path, other, place)] = values
    pages, slots = kinds[HOST]["", "", 0][0], kinds[SLOT]
    dense = sorted(p for p, v in slots.items() if v[4] >= LINKED * v[3] and words_of(p.rpartition("/")[2])[0] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "article", "main"))
    literals = sorted((p, place) for (p, _, place), v in kinds[TEXT].items() if v[1] == v[2] and v[0] >= LITERAL_PAGES and slots[p][1] == slots[p][2] and v[0] == slots[p][0] and level(p) < 3 and p not in dense)
    fixed = defaultdict(int)
    for p, _ in literals:
        fixed[p] += 1
    if not any(level(p) < 3 and p not in dense and fixed[p] < v[2] for p, v in slots.items()):
        literals = []  # copies of one page tell nothing about their template
    expression = _expression(kinds[ELEMENT], set(slots), [(a, b) for a, b, _ in kinds[PAIR]], pages)
    return pages, expression, _article(slots), dense, [p for p, _ in literals], [k for _, k in literals], [slots[p][1] for p, _ in literals]


WRAPPER = "host string, pages long, wrapper string, article string, links array<string>, literal_paths array<string>, literal_places array<int>"


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """A row for each host: pages, wrapper (the expression as text), article (path of the element that holds most text),
    links (paths of slots that are lists of links), and paths and places of literals; stored.

    A group of a host has a row for each distinct path and place in it, however many pages the host has.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ALIGNED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 5
        rows: dict[tuple, list[int]] = {}

        def taken() -> pa.RecordBatch:
            columns = list(zip(*((*k, *v) for k, v in rows.items()), strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for part in parts:
            for host, html in zip(part.column(0), part.column(1), strict=True):
                _align(rows, host.as_py(), html.as_py())
                if len(rows) >= HELD:
                    yield taken()
        if rows:
            yield taken()

    keys = ["host", "kind", "path", "other", "place"]
    aligned = pages.select(url_parts(F.col("url"))[0].alias("host"), "html").mapInArrow(batches, _ALIGNED).groupBy(*keys)
    aligned = aligned.agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    aligned = aligned.where((F.col("kind") != TEXT) | ((F.col("low") == F.col("high")) & (F.col("pages") >= LITERAL_PAGES)))

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        n, wrapper, article, links, paths, places, _ = _wrapper(list(zip(*(rows.column(c).to_pylist() for c in (*keys[1:], "pages", "low", "high", "chars", "linked")), strict=True)))
        strings = pa.list_(pa.string())
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "pages": pa.array([n], pa.int64()), "wrapper": pa.array([wrapper], pa.string()), "article": pa.array([article], pa.string()), "links": pa.array([links], strings), "literal_paths": pa.array([paths], strings), "literal_places": pa.array([places], pa.list_(pa.int32()))})

    return stored(aligned.groupBy("host").applyInArrow(fold, WRAPPER), "wrappers")


def main_text(html: str | None, article: str, links: frozenset[str], literals: frozenset[tuple[str, int]]) -> str:
    """The text of one page by the wrapper of its host.

    Of its article elements; without one, of the elements named as main content; without one, of the element that
    holds most text on the host's pages.
    """
    page = parse(html)
    wanted = min((lv for lv in map(level, page.counts) if lv < 2), default=2)
    out, seen = [], defaultdict(int)
    for path, text, _ in page.blocks:
        place = seen[path]
        seen[path] += 1
        if level(path) != wanted or path in links or (path, place) in literals:
            continue
        if wanted == 2 and article and not (path == article or path.startswith(f"{article}/")):
            continue
        out.append(text)
    return " ".join(out)


def extract_text(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages(page_id, url, html); wrappers as inferred.

    A null html is empty; a page without main text has an empty one. Rows with a null url or one without a
    host share the empty host. Null and repeated page_ids stay, other columns are left out, an empty table
    gives no rows.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for part in parts:
            texts = []
            for html, article, links, paths, places in zip(*(part.column(k).to_pylist() for k in range(2, 7)), strict=True):
                key = (article, tuple(links or ()), tuple(paths or ()), tuple(places or ()))
                if key not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = (article or "", frozenset(key[1]), frozenset(zip(key[2], key[3], strict=True)))
                texts.append(main_text(html, *known[key]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    # Spark broadcasts the hosts where their table is small enough, and else splits hot hosts of the join
    of_host = wrappers.select(F.col("host").alias("_host"), "article", "links", "literal_paths", "literal_places")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", url_parts(F.col("url"))[0].alias("_host"))
    return rows.join(of_host, "_host", "left").select("page_id", "url", "html", "article", "links", "literal_paths", "literal_places").mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def main_texts(pages: DataFrame) -> DataFrame:
    """The text of each page by the wrapper of its host, inferred from all of the host's pages."""
    return extract_text(pages, infer_wrappers(pages))
