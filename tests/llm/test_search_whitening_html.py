"""Ranked search, whitening and HTML extraction against plain versions."""

import html
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodemark.llm import html_text, search, whitening

# ------------------------------------------------------------------ search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, most=20):
    """[(item id, [(score, doc id)])] by the definition."""
    lists = [(d, plain_terms(t)) for d, t in docs]
    n, total = sum(bool(t) for _, t in lists), sum(len(t) for _, t in lists)
    frequency = Counter(x for _, t in lists for x in set(t))
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for x, df in frequency.items()}
    out = []
    for item, text in items:
        found = []
        for d, terms in lists:
            m = 75 + 25 * len(terms) * n // total if terms else 0
            tf = Counter(terms)
            score = sum(weight[x] * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in plain_terms(text) if x in tf)
            if score > 0:
                found.append((-score, d is None, d if d is not None else 0))
        out.append((item, [(-s, None if null else d) for s, null, d in sorted(found)[:most]]))
    return out


def check_search(spark, docs, items, most=20):
    d = spark.createDataFrame(docs, "doc_id long, text string, item long, rank string, score string").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string, doc_id long, item string")
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in search.search(d, i, most).collect())
    plain = plain_search([x[:2] for x in docs], sorted({x[:2] for x in items if x[1] is not None}, key=str), most)
    assert got == Counter((item, k, d, s) for item, found in plain for k, (s, d) in enumerate(found, 1))
    return got


def some_documents():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "naïve", "ſ", "x-y", "A1", "K"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 60))) for _ in range(120)]
    texts += [None, "", "  ..!! ", "THE the The", "été\x00Été", "w1 " * 30_000, "w1", "w1", "w1"] + ["same words w3"] * 40
    return [(k * 7 % 1000, t, 0, "r", "s") for k, t in enumerate(texts)] + [(5, "w2 w2", 0, "r", "s"), (5, "w2 w2", 0, "r", "s"), (None, "w1 w3", 0, "r", "s"), (None, None, 0, "r", "s")]


ITEMS = [(0, "w1 w1 W2, w3!", 1, "i"), (1, "Été ÉTÉ naïve; ſ K k", 1, "i"), (1, "a second text of item one: w5", 1, "i"), (2, "", 1, "i"), (3, None, 1, "i"), (4, "unknown", 1, "i"), (5, " ".join(f"w{k}" for k in range(60)), 1, "i"), (5, " ".join(f"w{k}" for k in range(60)), 1, "i"), (None, "w9", 1, "i")]


@pytest.mark.parametrize(("entries", "most"), [(2 << 20, 20), (50, 3)])
def test_search_equals_the_definition(spark, monkeypatch, entries, most):
    monkeypatch.setattr(search, "ENTRIES", entries)
    found = check_search(spark, some_documents(), ITEMS, most)
    assert sum(found.values()) > 3 * most


def test_items_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_ITEMS", 2)
    check_search(spark, some_documents(), ITEMS)


def test_search_in_empty_tables(spark):
    assert not check_search(spark, [], ITEMS) and not check_search(spark, some_documents(), [])
    assert not check_search(spark, [(1, None, 0, "", ""), (2, "..", 0, "", "")], ITEMS)


def test_search_of_the_given_tables(spark, sf):
    d, i = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    got = {(r["item_id"], r["rank"]): (r["score"], r["doc_id"]) for r in search.op11_ranked_search(spark, sf).collect()}
    want = plain_search(list(zip(d.doc_id.tolist(), d.text, strict=True)), list(zip(i.item_id.tolist(), i.text, strict=True)))
    assert got == {(item, k): pair for item, found in want for k, pair in enumerate(found, 1)}


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(2)
    for top in (1, 1 << 10, 1 << 20, 1 << 40, 1 << 62):
        keys = rng.integers(0, top, 3000)
        assert (search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(search.radix_order(np.zeros(0, np.int64))) == 0


# ------------------------------------------------------------------ whitening


def plain_whitening(rows, most=16):
    """(ids, whitened, deviations, shares, n) by numpy in full dimension."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    z = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > 1e-9 * values[0]).sum())
    return [i for i, _ in kept], ((n * x - sums) / n) @ vectors[:, :k] / np.sqrt(values[:k]), ((n * x - sums) ** 2).sum(axis=1), values[:k] / values.sum(), n


def check_whitening(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, x int, component string").repartition(3)
    got = whitening.whitened(df).toPandas()
    ids, white, deviations, shares, n = plain_whitening([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    k = white.shape[1]
    assert len(got) == len(ids) * k and set(got.component) == set(range(1, k + 1)) and set(got.n) == {n} and got.identity_error.max() < 1e-8
    for c in range(1, k + 1):
        own = got[got.component == c]
        assert np.isclose(own.explained.iloc[0], shares[c - 1], rtol=1e-9) and own.explained.nunique() == 1
        a = own.groupby("vec_id", dropna=False).whitened.apply(lambda s: sorted(s))
        b = pd.DataFrame({"vec_id": pd.array(ids, "Float64").astype(float), "w": white[:, c - 1]}).groupby("vec_id", dropna=False).w.apply(lambda s: sorted(s))
        flip = b.apply(lambda s: sorted(-v for v in s))
        assert any(all(np.allclose(u, v, atol=1e-7) for u, v in zip(a, other, strict=True)) for other in (b, flip))
    assert Counter(got[got.component == 1].deviation) == Counter(deviations.tolist())
    return got


def vectors(n, d, seed, gap=1.0):
    rng = np.random.default_rng(seed)
    scale = np.exp(-gap * np.arange(d) / 4)
    return (rng.normal(size=(n, d)) * scale).astype(np.float32)


@pytest.mark.parametrize(("d", "gap"), [(64, 0.0), (64, 1.0), (12, 0.1), (16, 0.5), (40, 3.0)])
def test_whitening_equals_a_full_decomposition(spark, d, gap):
    x = vectors(300, d, d, gap)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(k, x[0].tolist()) for k in range(500, 600)]
    check_whitening(spark, rows)


def test_whitening_of_awkward_rows(spark):
    x = vectors(80, 20, 1)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1, x[1].tolist()), (None, x[2].tolist()), (None, (x[2] * 2).tolist()), (90, None), (91, []), (92, [None] + x[0].tolist()[1:]), (93, [float("nan")] + x[0].tolist()[1:]), (94, [float("inf")] + x[0].tolist()[1:])]
    got = check_whitening(spark, rows)
    assert {90, 91, 92, 93, 94}.isdisjoint(set(got.vec_id.dropna()))
    other = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(200, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert 200 not in {r["vec_id"] for r in whitening.whitened(other).collect()}


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 7.0, 2.0 * k]) for k in range(9)], schema)).toPandas()
    assert set(flat.component) == {1} and np.isclose(flat.explained.iloc[0], 1.0) and np.isclose(flat.whitened.std(ddof=0), 1.0)
    large = whitening.whitened(spark.createDataFrame([(k, [1e30 if k == 3 else float(k), float(k % 3)]) for k in range(9)], schema)).toPandas()
    assert large.deviation.isna().all() and len(large) >= 9


def test_the_range_finder_stops_early_only_where_it_is_right(spark, monkeypatch):
    """With a fast falling spectrum the block stays small, with a flat one it grows to all dimensions."""
    widths = {}
    for gap in (0.0, 6.0):
        x = np.floor(vectors(400, 64, 3, gap).astype(float) * 64 * 1000).astype(int) + 1_000_000
        own = whitening.fit(spark.createDataFrame([(v.tolist(),) for v in x], "x array<long>"), components=4)
        widths[gap] = own.directions
        z = x - x.mean(axis=0)
        values = np.linalg.eigvalsh(z.T @ z / len(x))[::-1]
        assert np.allclose(own.values, values[:4], rtol=1e-9)
    assert widths == {0.0: 64, 6.0: 20}


def test_sums_are_exact_for_entries_of_any_size(spark):
    rows = [[1 << 61, -5], [1 << 61, 7], [(1 << 61) - 3, 1 << 40]]
    found = whitening._exact_sums(spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(2)).collect()
    assert [int(r["total"]) for r in found] == [sum(r[k] for r in rows) for k in (0, 1)]
    z = whitening.centred(np.array(rows), 3, [sum(r[k] for r in rows) for k in (0, 1)])
    assert z.tolist() == [[3 * r[k] - sum(q[k] for q in rows) for k in (0, 1)] for r in rows]


# ------------------------------------------------------------------ html

PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody had expected it so early in the year."
SHORT = ["Yes.", "No.", "Why?", "It rained."]


def boilerplate(side):
    """Pieces that belong to no article, with markup, classes and roles in use."""
    return {
        "menu": '<nav><ul><li><a href="/a">Home</a><li><a href="/b">All the articles of this year</a></ul></nav>',
        "header": f"<header><div>{side}</div></header>",
        "cookie": f'<div class="cookie-notice"><p>{side}</p><button>Accept</button></div>',
        "role": f'<div role="banner"><p>{side}</p></div>',
        "aside": f"<aside><h3>More</h3><p>{side}</p></aside>",
        "sidebar": f'<div id="rightSidebar"><p>{side}</p><p>{side}</p></div>',
        "advert": f'<div class="ad"><p>{side}</p></div>',
        "form": f'<form action="/s"><label>{side}</label><input name="q"><textarea>{side}</textarea></form>',
        "script": f'<script>var t = "<p>{side}</p>";</script><style>p {{ color: red }}</style><noscript>{side}</noscript>',
        "comments": f'<section class="comments"><h3>Comments</h3><article class="comment"><p>{side}</p></article><div><p>{side}</p></div></section>',
        "footer": f"<footer><p>&copy; 2026 {side}</p></footer>",
        "hidden": f'<div style="display: none"><p>{side}</p></div><div hidden>{side}</div>',
        "comment": f"<!-- <p>{side}</p> -->",
    }


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div itemprop="articleBody">{}</div>', '<form id="page"><article>{}</article></form>', "<div>{}</div>"])
def test_the_article_and_nothing_else(wrap):
    side = "Words beside the article that nobody wants, in whole sentences of some length, more than once. They go on and on."
    blocks = ["A title of the page", PROSE, *SHORT, PROSE + " & more: 1 < 2", PROSE]
    article = "<h1>A title of the page</h1>" + f"<p>{PROSE}" + "".join(f"<p>{s}</p>" for s in SHORT) + '<div class="ad">' + side + "</div>" + f"<p>{PROSE.replace('river', '<b>ri</b>ver')} &amp; more: 1 &lt; 2</p><p>{PROSE.replace(' ', chr(10) + '  ')}</p>"
    pieces = boilerplate(side)
    for chosen in (list(pieces), ["menu", "footer"], ["cookie", "comments"], []):
        before = "".join(pieces[k] for k in chosen if k not in ("comments", "footer"))
        after = "".join(pieces[k] for k in chosen if k in ("comments", "footer"))
        page = f"<!DOCTYPE html><html><head><title>{side}</title></head><body class='has-sidebar'>{before}{wrap.format(article)}{after}</body></html>"
        assert html_text.main_text(page) == " ".join(blocks), (wrap, chosen)


def test_short_lines_beside_prose_without_any_marks():
    page = "<div>Home</div><div>News</div><div><a href=x>A link of quite some length that leads elsewhere</a></div>" + f"<div>{PROSE}</div><div>Yes.</div><div>{PROSE}</div>" + "<div>Imprint</div><div>Privacy</div>"
    assert html_text.main_text(page) == f"{PROSE} Yes. {PROSE}"


def test_broken_and_odd_pages():
    t = html_text.main_text
    assert [t(x) for x in (None, "", "   ", "<p></p>", "<nav><a href=x>Home</a></nav>", "<!-- x", "<script>x", "<")] == [""] * 7 + ["<"]
    assert t("just words") == "just words" and t("a&nbsp;&#x41;&bogus; &am &amp") == "a A&bogus; &am &"
    assert t("<p>one<p>two<br>three<b>x</b>y") == "one two threexy"
    assert t('<article><p title="a > b">in</p><p title="open>out</p></article>') == "in out"
    assert t("<ARTICLE><P>Up</P></ARTICLE><FOOTER>down</FOOTER>") == "Up"
    assert t("<article><header><h1>Title</h1></header><p>Text.</p><footer>foot</footer></article>") == "Title Text."
    long = "<article>" + "".join(f"<p>{PROSE} {k}</p>" for k in range(30_000)) + "</article>"
    assert t(long) == " ".join(f"{PROSE} {k}" for k in range(30_000))
    for bad in ("<a '\">", "<", "<a ", "<!--", "<b>", "<div>", '<a href="x>', "<script>", "<svg", "&", "</p>", "<p class='"):
        t(bad * 30_000)


def test_the_given_pages(spark, sf):
    """Their articles, cut out by their tags."""
    pages = pd.read_parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.op13_html_extraction(spark, sf).collect()}
    assert len(got) == len(pages)
    for page_id, url, page in pages[["page_id", "url", "html"]].itertuples(index=False):
        inner = re.search("<article>(.*?)</article>", page, re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match("</?(p|h1|br)>", m[0]) else "", inner))
        assert got[page_id]["text"] == " ".join(text.split()) and got[page_id]["url"] == url and got[page_id]["n_chars"] == len(got[page_id]["text"])


def test_extraction_of_awkward_tables(spark):
    rows = [(1, "u", "<p>x</p>", "t", 3), (1, "u", "<p>x</p>", "t", 3), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    assert Counter(tuple(r) for r in html_text.extract(df).collect()) == Counter({(1, "u", "x", 1): 2, (None, None, "", 0): 1})
    assert html_text.extract(df.limit(0)).count() == 0
