"""Whitening, the prefix trie and html extraction against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import common, htmlblocks, oracles, queries, trie, whitening, wrappers
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def test_whitening_against_numpy(spark):
    found = queries.queries()["op11_embedding_whitening"](spark, MIDDLE).toPandas()
    rows = spark.read.parquet(f"{MIDDLE}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack(rows.embedding).astype(float)).astype(int)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert len(found) == 4 * len(rows) and set(found.n) == {n} and found.identity_error.max() < 1e-9
    for c in range(1, 5):
        some = found[found.component == c].set_index("vec_id").loc[rows.vec_id]
        assert (some.deviation.to_numpy() == ((n * x - sums) ** 2).sum(axis=1)).all()
        assert np.allclose(some.explained, values[-c] / values.sum(), rtol=1e-9)
        white = (x - sums / n) @ vectors[:, -c] / np.sqrt(values[-c])
        assert min(np.abs(some.whitened.to_numpy() - white).max(), np.abs(some.whitened.to_numpy() + white).max()) < 1e-8


def test_whitening_over_several_tiles_and_blocks(spark, monkeypatch):
    """Dimensions that leave a short tile, row blocks of a few rows, and one vector in a third of all rows."""
    monkeypatch.setattr(whitening, "ROWS", 7)
    monkeypatch.setattr(whitening, "TILE", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 10)) * np.arange(1, 11)
    x[::3] = x[0]
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = whitening.whiten(rows.repartition(5)).toPandas()
    z = np.floor(256 * x)
    fit = np.unique(z, axis=0)
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1]
    assert len(fit) == 61 and set(found.n) == {61} and len(found) == 360
    assert np.allclose(sorted(set(found.explained), reverse=True), values[:4] / values.sum())
    white = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()[np.unique(z, axis=0, return_index=True)[1]]
    assert np.allclose(white.T @ white / 61, np.eye(4), atol=1e-9) and np.allclose(white.mean(axis=0), 0, atol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [0.5, 0.25], [1.0, 2.0]]
    odd = [None, [], [1.0], [None, 1.0], [nan, 1.0], [inf, 1.0], [-inf, 0.0]]
    rows = [(i, v, 1, 1.0) for i, v in enumerate(good)] + [(None, [3.0, 1.0], 1, 1.0), (0, [-0.001, 9.0], 2, 2.0)] + [(50 + i, v, 3, 3.0) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened double")
    found = whitening.whiten(table).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in found) == sorted((i is None, i or 0, c) for i in (0, 1, 2, 3, None, 0) for c in (1, 2))
    assert {r.n for r in found} == {5}
    assert whitening.whiten(table.where("vec_id >= 50 and size(embedding) <> 1")).collect() == []
    assert whitening.whiten(table.where("vec_id in (1) or vec_id = 50")).collect() == []  # one distinct vector
    assert whitening.whiten(table.limit(0)).collect() == []
    far = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(far).collect()} >= {None}


def plain_trie(rows):
    """Nodes of the rebuilt conversations by their prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[0], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        own[conv] = [t[1:] for t in turns]
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        first = int(conv - (abs(conv) % 20) * (1 if conv >= 0 else -1))
        whole[conv] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    words = lambda text: len([w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w])
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * words(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(path)))
        out.add((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth long, unit string"


def test_trie_against_plain_prefixes(spark):
    """Few words, so that long prefixes are shared; copies, prefixes of others, and conversations without turns."""
    rng = random.Random(7)
    rows = []
    for conv in [*range(0, 66), -3, 10_000, 10_001]:
        if conv % 20 == 0 and conv and conv != 40:
            continue  # groups without a first conversation
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((conv, None if rng.random() < 0.05 else turn * 3, rng.choice(["user", "user", None]), rng.choice(["a b", "a b", "", None, "c"])))
    rows += [(c, t, "user", "same turn") for c in range(200, 230) for t in range(150 + (c == 229))]  # long copies and one that goes on
    rows += [(7, 0, "user", "a b"), (7, 0, "user", "a b"), (None, 1, "user", "x"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(4)
    assert set(map(tuple, trie.prefix_trie(frame).collect())) == plain_trie(rows)
    assert trie.prefix_trie(frame.limit(0)).collect() == []
    assert trie.prefix_trie(frame.where("conv_id is null")).collect() == []


def test_trie_against_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{MIDDLE}/conversations.parquet'")
    found = queries.queries()["op12_prefix_trie"](spark, MIDDLE)
    expected = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({oracles.oracle_sql()['op12_prefix_trie']}) AS x").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected)) and expected


def test_ends_of_many_ids_in_chunks(spark):
    ids = [-5000, -1, *range(0, 20_000, 3), 2**62]
    members = spark.createDataFrame([(1, i) for i in ids] + [(2, 9), (2, 10)], "unit long, conv_id long").repartition(7)
    found = dict(trie._joined_ids(members).collect())
    assert found == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"9,10").hexdigest()}


def test_numbers_of_a_key_over_many_ranges(spark):
    rows = [(1, i % 50) for i in range(3000)] + [(2, None), (2, 5), (3, 1)]
    frame = spark.createDataFrame(rows, "k long, at int").repartition(6)
    found = defaultdict(list)
    for r in common.numbered(frame, "k", ["at"], "n").collect():
        found[r.k].append((r.n, r.at))
    assert [n for n, _ in sorted(found[1])] == list(range(3000)) and [a for _, a in sorted(found[1])] == sorted(i % 50 for i in range(3000))
    assert sorted(found[2]) == [(0, None), (1, 5)] and found[3] == [(0, 1)]


PAGES = "page_id long, url string, html string, text string, host string"
NAV = "<header><a href='/'>Site</a><h1>Site name</h1></header><nav><ul><li><a href=/a>Home<li><a href=/b>News</ul></nav>"


def site(kind, i, title, body):
    """A page of one of several templates, and the text that a reader came for."""
    ps = "".join(f"<p>{b}</p>" for b in body)
    text = " ".join([title, *body])
    if kind == 0:
        return f"<!DOCTYPE html><html><body>{NAV}<article class='post-{i}'><header><h1>{title}</h1><p class=byline>By someone</p></header>{ps}<div class='share-buttons'>Share this</div></article><aside>More {i}</aside><section class=comments><article><p>First! {i}</p></article></section><footer>&copy; {i}</footer>", text
    if kind == 1:
        return f"<div id=top class='cookie-notice'>We use cookies</div><DIV CLASS=menu>{i} links</DIV><main><h2>{title}</h2>{ps.replace('</p>', '')}<form><p>Your mail {i}</p></form><script>if (a < b) document.write('<p>no</p>')</script></main><div class=sidebar><p>Popular {i}</p></div>", text
    if kind == 2:  # nothing says what is what; the template's own words never change
        return f"<body><div class=x1><span>Welcome to the site</span></div><div class=x2><div><h1>{title}</h1></div>{ps}<div class=x9>All rights reserved</div></div><div class=x3><ul><li><a>{i}</a></li><li><a>Next page</a></li></ul></div></body>", text
    return f"<table><tr><td class=menu>Menu {i}<td class=content><h1>{title}</h1>{ps}</table><!-- <p>not this</p> --><style>p > b {{}}</style>", text


def test_main_text_of_several_templates(spark):
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(160):
        sentence = lambda: " ".join(rng.choices("river stone light paper winter garden under over".split(), k=rng.randint(6, 14))).capitalize() + "."
        html, text = site(i % 4, i, f"Title {i} of it", [sentence() for _ in range(rng.randint(3, 6))])
        rows.append((i, f"https://Host{i % 4}.example.com/p/{i}?q#x", html, "clash", "clash"))
        truth[i] = text
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    found = {r.page_id: r for r in wrappers.main_texts(pages).collect()}
    assert {i: found[i].text for i in truth} == truth and all(r.n_chars == len(r.text) for r in found.values())
    shown = {r.host: r.wrapper for r in wrappers.infer_wrappers(pages).collect()}
    assert "<div.menu>#</div.menu>" in shown["host1.example.com"] and "<p>#</p>+" in shown["host1.example.com"]
    # hosts are joined alike where Spark may not broadcast them
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.page_id: r.text for r in wrappers.main_texts(pages).collect()} == truth
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_html_extraction_of_pages(spark):
    """Against the article element, read by a rule for this table's template."""
    import re
    from html import unescape

    found = queries.queries()["op13_html_extraction"](spark, MIDDLE).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        inside = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id].html)[1]
        blocks = re.split(r"</?(?:p|h1)>|<br>", inside.replace("<b>", ""))
        assert r.text == " ".join(" ".join(unescape(b) for b in blocks).split()) and r.url == pages[r.page_id].url


def test_repeated_and_optional_groups():
    rows = {}
    for html in ("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x", "<dl><dt>a<dd>b</dl><div class=promo-1>buy</div><p>y"):
        wrappers._align(rows, "h", html)
    pages, shown, *_ = wrappers._wrapper([(*key[1:], *values) for key, values in rows.items()])
    assert pages == 2 and shown == "<dl>(<dd>#</dd>?<dt>#</dt>?)+</dl><div.promo-0>#</div.promo-0>?<p>#</p>"


@pytest.mark.parametrize(
    "html, blocks",
    [
        (None, []),
        ("", []),
        (" \n ", []),
        ("plain &amp; simple&nbsp;text < 3", ["plain & simple text < 3"]),
        ("<p>a<b>b</b>c<br>d<p>e", ["abc d", "e"]),
        ("<p>a<!-- x --><p>b<!-- <p>c", ["a", "b"]),
        ("<p title='a > b'>c</p><p>d <script>'</p>'</script>e", ["c", "d e"]),
        ("</div></p><p>stray", ["stray"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>cut <a hre", ["cut <a hre"]),
        ("&lt;p&gt;&#x41;&#66;", ["<p>AB"]),
    ],
)
def test_blocks(html, blocks):
    assert [text for _, text, _ in htmlblocks.parse(html).blocks] == blocks


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (None, "http://a/x", "<article>t</article>"), (2, "no host", deep), (3, "http://b/", long), (3, "http://b/", long), (4, "HTTP://B?x", "<article></article><p>other")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)
    found = sorted((str(r.page_id), r.text[:20], r.n_chars) for r in wrappers.main_texts(pages).collect())
    words = " ".join(["word"] * 20_000)
    assert found == sorted([("1", "", 0), ("2", "", 0), ("None", "t", 1), ("2", "deep", 4), ("3", words[:20], len(words)), ("3", words[:20], len(words)), ("4", "", 0)])
    assert wrappers.main_texts(pages.limit(0)).collect() == []


def test_small_tables(spark):
    assert queries.queries()["op13_html_extraction"](spark, SMALL).where(F.col("n_chars") == 0).count() == 0
