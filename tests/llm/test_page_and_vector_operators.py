"""Main text of pages, source divergences and vector codes, against brute force, with their edge cases."""

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, html_text, vector_codes
from plumbline.llm import html_layouts as layouts
from plumbline.llm import html_tree as ht

def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("id", "v", "label2", "n", "g", "h", "sid", "term", "item", "rank", "part", "code", "error", "value")})


# ------------------------------------------------------------ trees


def tree_of(page):
    tree = ht.Tree()
    ht.add_page(tree, page)
    return tree


def test_elements_close_as_in_browsers():
    tree = tree_of("<p>a<b>b<p>c</b> d<div>e <i>f</i>g</div></article><ul><li>x<li>y<script>if (a<b) '</p>'</script>z<!-- > --></ul><table><tr><td>1<td>2<tr><td>3</table>r < s <a title='u>v'>w</a><p title=\"")
    path = lambda i: (path(tree.parent[i]) + "/" if tree.parent[i] > 0 else "") + tree.tags[i]
    said = [(path(p[0]), p[1]) for p in tree.pieces if p]
    assert said == [
        ("p", "a"), ("p/b", "b"), ("p", "c"), ("p", " d"), ("div", "e "), ("div/i", "f"), ("div", "g"), ("ul/li", "x"), ("ul/li", "y"), ("ul/li", "z"),
        ("table/tr/td", "1"), ("table/tr/td", "2"), ("table/tr/td", "3"), ("html", "r < s "), ("a", "w"),
    ]


@pytest.mark.parametrize("page", ["", "<", "<<<<", "</", "</>", "<a", "<a href='", "<!--", "<!", "<script>", "</p></p>", "<p", "&", "<td><tr><li></table>", "\x00<p>\x00", "<div>" * 3000 + "deep", "<b>" * 500 + "<p>" * 500 + "x"])
def test_broken_markup(page):
    assert len(html_text.texts([page, page + "<p>more"], html_text.fit_pages([], composed=3, steps=2))) == 2


def random_forest(rng, trees=3, most=6):
    tree = ht.Tree()
    for _ in range(trees):
        tree.pages.append((len(tree.tags), 0))
        for i in range(rng.randint(1, most)):
            first = tree.pages[-1][0]
            up = rng.randrange(first, len(tree.tags)) if i else -1
            tree.tags.append("div")
            tree.parent.append(up)
            tree.depth.append(tree.depth[up] + 1 if i else 0)
            for name in ("kind", "hints", "chars", "linked", "stops", "sign"):
                getattr(tree, name).append(rng.randint(0, 3))
    return ht.arrays(tree)


@pytest.mark.parametrize("seed", range(4))
def test_marginals_equal_enumeration(seed):
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    a = random_forest(rng)
    n = len(a["kind"])
    score, edges, kinds = draw.normal(size=n), draw.normal(size=(html_text.EDGES, 2, 2)), draw.integers(0, html_text.EDGES, n)
    marginal, pairs, logs = html_text.sum_product(a, score, edges, kinds)
    for page in range(3):
        own = np.flatnonzero(a["page"] == page)
        weights, ones, joint = 0.0, Counter(), Counter()
        for state in itertools.product((0, 1), repeat=len(own)):
            at = dict(zip(own.tolist(), state, strict=True))
            w = math.exp(sum(score[i] * s for i, s in at.items()) + sum(edges[kinds[i], at[a["parent"][i]], at[i]] for i in at if a["parent"][i] >= 0))
            weights += w
            for i, s in at.items():
                ones[i] += w * s
                if a["parent"][i] >= 0:
                    joint[i, at[a["parent"][i]], s] += w
        assert math.isclose(math.log(weights), logs[page])
        assert np.allclose(marginal[own], [ones[i] / weights for i in own.tolist()])
        for (i, p, c), w in joint.items():
            assert math.isclose(pairs[i, p, c], w / weights)


def test_slopes_are_those_of_the_loss():
    draw, a = np.random.default_rng(1), random_forest(random.Random(5), trees=6)
    n = len(a["kind"])
    x, kinds, y = draw.normal(size=(n, 3)), draw.integers(0, html_text.EDGES, n), draw.integers(0, 2, n)
    weights, edges = draw.normal(size=3), draw.normal(size=(html_text.EDGES, 2, 2))
    _, dw, de = html_text.loss_and_slopes(weights, edges, a, x, kinds, y, 0.1)
    loss = lambda w, e: html_text.loss_and_slopes(w, e, a, x, kinds, y, 0.1)[0]
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert math.isclose((loss(weights + step, edges) - loss(weights - step, edges)) / 2e-6, dw[i], abs_tol=1e-5)
    for i in np.ndindex(edges.shape):
        step = np.zeros_like(edges)
        step[i] = 1e-6
        assert math.isclose((loss(weights, edges + step) - loss(weights, edges - step)) / 2e-6, de[i], abs_tol=1e-5)


# ------------------------------------------------------------ main text


@pytest.fixture(scope="module")
def raw_pages(spark, sf):
    return [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(raw_pages):
    return html_text.fit_pages(raw_pages[:30])


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", "\n", body).replace("<b>", "").replace("</b>", "")).split())


def test_articles_of_pages_not_fitted_on(raw_pages, model):
    assert html_text.texts(raw_pages[30:], model) == [article(p) for p in raw_pages[30:]]


def test_layouts_not_fitted_on(raw_pages, model):
    parts, rng = layouts.Parts(raw_pages[30:]), random.Random(77)
    found = missed = wrong = 0
    for _ in range(200):
        page = layouts.compose(parts, rng)
        text = html_text.texts([page], model)[0]
        found, wrong = found + text.count(layouts.CONTENT), wrong + text.count(layouts.ASIDE)
        missed += sum(1 for p in tree_of(page).pieces if p and layouts.CONTENT in p[1]) - text.count(layouts.CONTENT)
    assert found / (found + missed) > 0.93 and found / (found + wrong) > 0.96


REAL = [
    (
        """<html><body><header><a href="/">The Daily</a><p>News of the day</p></header><nav><a href="/a">World</a> <a href="/b">Sport</a></nav>
        <div class="cookie-notice"><p>We use cookies to make this site better. By going on you agree.</p><button>OK</button></div>
        <main><article><h1>A  quiet\n harbour</h1><p>The ferry leaves at dawn, and the <a href="/h">harbour</a> is quiet &amp; cold.</p>
        <div class="advert">Buy new boats now. Only today.</div><p>Boats come back at noon.</p><form><label>Mail</label><input><button>Subscribe</button></form></article></main>
        <aside class="sidebar"><h3>Related</h3><p>Another story about the sea that you may like. It is long enough.</p></aside>
        <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thank you for it. More please.</p></div></section>
        <footer><p>&copy; 2024 The Daily. All rights reserved.</p></footer></body></html>""",
        "A quiet harbour The ferry leaves at dawn, and the harbour is quiet & cold. Boats come back at noon.",
    ),
    (
        """<body><div id="header"><h1>My log</h1></div><ul class="menu"><li><a href="1">Home</a></li><li><a href="2">About</a></li></ul>
        <div id="content"><h2>On rain</h2><p>It rained for a week, and then some more.<p>Nobody minded, though the road was gone.</div>
        <div class="sidebar"><ul><li><a href="3">Older</a></li><li><a href="4">Newer</a></li></ul></div><div id="footer">Made by hand.</div></body>""",
        "On rain It rained for a week, and then some more. Nobody minded, though the road was gone.",
    ),
]


@pytest.mark.parametrize("page, text", REAL)
def test_common_layouts(model, page, text):
    assert html_text.texts([page], model) == [text]


def test_odd_pages(spark, model, raw_pages):
    rows = [(1, "u", None), (2, None, ""), (None, "v", raw_pages[0]), (None, "v", raw_pages[0]), (3, "w", "<article><p>" + "long text here. " * 60_000 + "</p></article>"), (4, "x", "   ")]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumns({"text": F.lit("t"), "n_chars": F.lit(5)})
    got = sorted((tuple(r) for r in html_text.extract_text(df, model).collect()), key=str)
    long = ("long text here. " * 60_000).strip()
    want = [(1, "u", "", 0), (2, None, "", 0), (None, "v", article(raw_pages[0]), len(article(raw_pages[0]))), (None, "v", article(raw_pages[0]), len(article(raw_pages[0]))), (3, "w", long, len(long)), (4, "x", "", 0)]
    assert got == sorted(want, key=str)
    assert html_text.extract_text(df.limit(0), html_text.fit_text(df.limit(0))).count() == 0


# ------------------------------------------------------------ divergence


def brute_audit(rows, least=3, top=200):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = [w.translate(lower) for w in word.findall(text or "")]
        count[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        own = sorted(s for l, s in groups if l == lang)
        p = {}
        for s in own:
            n = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n + len(kept)) for t in kept}
        all_n = sum(count[lang, s][t] for s in own for t in kept)
        q = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in own) + 1) // (all_n + len(kept)) for t in kept}
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(found[:most], 1)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = ["Über", "the", "THE", "a1b", "naïve", "x", "y", "z", "ıİ", "Kelvin", "straße", "q-r", "中文", "…", "don't"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "ß"]), " ".join(rng.choices(words, k=rng.randint(0, 40)))) for _ in range(150)]
    return rows + [("fr", "s1", None), ("fr", "s2", ""), ("it", "only", "one two"), ("en", "new", "1 2 3"), rows[0], rows[0], ("en", "s1", "the long " * 20_000)]


@pytest.mark.parametrize("seed, cells", [(1, 1 << 22), (2, 7)])
def test_divergence_equals_brute_force(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    rows = audit_rows(seed)
    df = clashing(spark.createDataFrame(rows, "lang string, source string, text string")).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit_sources(df, top=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_audit(rows, top=7)
    assert divergence.audit_sources(df.limit(0)).count() == 0


def test_runs_cluster_equal_counts():
    draw = np.random.default_rng(3)
    counts, lengths = draw.integers(0, 3, (4, 60)), draw.integers(1, 9, 60)
    at, runs = divergence.run_columns(counts, lengths)
    assert at[-1] == lengths.sum() and min(len(s) for s, _ in runs) <= 3
    totals, kept = (counts * lengths).sum(axis=1), int(lengths.sum())
    p = 1 + divergence.UNIT * (counts + 1) // (totals[:, None] + kept)
    want = [[int(((p[g] - p[h]) ** 2 // p[h] * lengths).sum()) for h in range(4)] for g in range(4)]
    assert divergence.pair_sums(counts, lengths, totals, kept).tolist() == want


# ------------------------------------------------------------ vector codes


def brute_codes(rows, parts=16, entries=64):
    fine = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(fine[0][1]) // parts
    order = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[r[1][p * w : (p + 1) * w] for r in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v, p):
        own = v[p * w : (p + 1) * w]
        return min((far(own, c), e) for e, c in enumerate(books[p]))

    for _ in range(2):
        new = [list(b) for b in books]
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in fine:
                members[assign(v, p)[1]].append(v[p * w : (p + 1) * w])
            for e, found in members.items():
                new[p][e] = [sum(col) // len(found) for col in zip(*found, strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded, by_label = [], Counter()
    for i, v, label in fine:
        found = [assign(v, p) for p in range(parts)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
        by_label[label] += coded[-1][2]
    return sorted(((i, c, e, by_label[label], digest) for i, c, e, label in coded), key=str)


def vectors(seed, n=200, width=32):
    rng = random.Random(seed)
    make = lambda: [rng.choice([rng.gauss(0, 1), rng.randint(-3, 3) / 2, 0.0]) for _ in range(width)]
    rows = [(i, make(), rng.choice([1, 2, None])) for i in rng.sample(range(1000), n)]
    hot = make()
    rows += [(2000 + i, hot, 7) for i in range(80)]
    odd = [(5000, None, 1), (5001, [None] + [0.0] * (width - 1), 1), (5002, [float("nan")] * width, 2), (5003, [float("inf")] + [0.0] * (width - 1), 2)]
    return rows + odd + [(None, make(), None), rows[0], rows[0], (rows[1][0], make(), 2)]


@pytest.mark.parametrize("seed, n", [(1, 200), (2, 5)])
def test_codes_equal_brute_force(spark, seed, n):
    rows = vectors(seed, n)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).repartition(4)
    got = sorted((tuple(r) for r in vector_codes.fit_transform(df)[0].collect()), key=str)
    assert got == brute_codes(rows)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [float("nan")] * 16, 1)], "vec_id long, embedding array<float>, label int")
    for some in (df, df.limit(0)):
        assert vector_codes.fit_transform(some)[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes.fit_transform(spark.createDataFrame([(1, [1.0] * 15, 1)], "vec_id long, embedding array<float>, label int"))
    lone = vector_codes.fit_transform(spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1), (3, [0.0] * 8, 1)], "vec_id long, embedding array<double>, label int"))[0].collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in lone) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]


def test_products_are_exact():
    draw = np.random.default_rng(4)
    for most in (3, 1 << 13, 1 << 20, 1 << 27):
        x, c = draw.integers(-most, most + 1, (3, 50, 8)), draw.integers(-most, most + 1, (3, 20, 8))
        want = [[[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in c[p]] for u in x[p]] for p in range(3)]
        assert vector_codes.exact_products(x, c).tolist() == want
