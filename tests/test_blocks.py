"""Blocks and scored blocks by windows against plain walks and loops."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pagelens.html import Page
from pagelens.operators import blocks as B
from pagelens.operators import evaluation as E
from pagelens.operators import metadata, nodes, tables
from pagelens.html import Sums


def walk(page):
    """Blocks by a plain walk down the tree."""
    out = []

    def below(i):
        return [page.tag[j] for j in page.tags(root=i) if j != i]

    def visit(i):
        for j in page.children(i):
            tag = page.tag[j]
            if not tag:
                continue
            inner = below(j)
            take = tag in B.LEAVES and not (tag == "li" and "li" in inner) and not (tag in ("p", "blockquote", "li") and "table" in inner)
            take |= tag in B.CONTAINERS and len(page.get_text(j)) >= 20 and not set(inner) & set(B.NESTED)
            if take:
                if page.get_text(j):
                    out.append((tag, page.get_text(j)))
            else:
                visit(j)

    for i in range(len(page)):
        if page.parent[i] < 0 and page.tag[i]:
            take = page.tag[i] in B.LEAVES + B.CONTAINERS
            out += [] if take else []
    return out, visit


def test_find_blocks_equals_a_plain_walk(spark):
    rnd = random.Random(3)
    parts = ["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</li></ul>", "<li>", "</li>", "<table><tr><td>", "</td></tr></table>", "<span>", "</span>", "<h2>head</h2>", " some words of text here ", " x ", "<blockquote>", "</blockquote>", "<section>", "</section>", "<nav>", "</nav>"]
    htmls = ["<body>" + "".join(rnd.choice(parts) for _ in range(40)) + "</body>" for _ in range(25)] + ["", None, "<body></body>", "<body><p>one<p>two</body>"]
    rows = B.find_blocks(nodes.nodes(spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string"))).orderBy("page_id", "idx").collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append((r.idx, r.tag, r.text, r.in_nav))
    for i, h in enumerate(htmls):
        page = Page(h)
        out, visit = walk(page)
        if len(page):
            visit(0) if page.tag[0] == "body" else None
        mine = got.get(i, [])
        assert [(t, x) for _, t, x, _ in mine] == out, h
        assert [k for k, *_ in mine] == list(range(len(mine)))
    page = spark.createDataFrame([(1, "<body><nav><p>inside of it</p></nav><p>outside of it</p></body>")], "page_id long, html string")
    assert [(r.text, r.in_nav) for r in B.find_blocks(nodes.nodes(page)).orderBy("idx").collect()] == [("inside of it", True), ("outside of it", False)]


def scored(spark, pages):
    rows = [(k, i, t, x, float(p), b, m) for k, page in enumerate(pages) for i, (t, x, p, b, m) in enumerate(page)]
    return spark.createDataFrame(rows, "page_id long, idx int, tag string, text string, p double, box int, is_title boolean")


def test_stack_equals_loops(spark):
    rnd = random.Random(4)
    pages = []
    for _ in range(12):
        box, page = 0, []
        for i in range(rnd.randint(1, 14)):
            box += rnd.random() < 0.4
            page.append(("p", "x" * rnd.randint(0, 30), rnd.random(), -1 if rnd.random() < 0.2 else box, False))
        pages.append(page)
    got = {(r.page_id, r.idx): r for r in B.stack(scored(spark, pages)).collect()}
    for k, page in enumerate(pages):
        p, w, box = [x[2] for x in page], [max(1, len(x[1])) for x in page], [x[3] for x in page]
        mean = []
        for i, b in enumerate(box):
            own = [j for j in range(len(page)) if box[j] == b] if b >= 0 else [i]
            mean.append(sum(p[j] * w[j] for j in own) / sum(w[j] for j in own))
        for i in range(len(page)):
            r = got[k, i]
            at = lambda j: p[j] if 0 <= j < len(p) else 0.5
            assert (r.p_prev, r.p_next, r.p_prev2, r.p_next2) == (at(i - 1), at(i + 1), at(i - 2), at(i + 2))
            j = i
            while j >= 0 and box[j] == box[i]:
                j -= 1
            assert r.box_before == pytest.approx(mean[j] if j >= 0 else 0.5) and r.box_mean == pytest.approx(mean[i])
            j = i
            while j < len(p) and box[j] == box[i]:
                j += 1
            assert r.box_after == pytest.approx(mean[j] if j < len(p) else 0.5)


def test_keep_rules(spark):
    long = "a text of more than thirty characters in all"
    page = [("h1", "Title of it", 0.0, 0, True), ("p", "eight words stand here right after the title", 0.2, 0, False), ("h2", "Head", 0.1, 0, False), ("p", "low", 0.3, 0, False), ("p", long, 0.9, 0, False), ("p", long.upper(), 0.9, 0, False), ("h2", "Far", 0.2, 0, False), ("p", "no", 0.0, 0, False), ("p", "no", 0.0, 0, False), ("p", "yes", 0.8, 0, False)]
    few = [("p", "kept", 0.0, 0, False)] * 3
    got = B.keep(scored(spark, [page, few])).orderBy("page_id", "idx").collect()
    assert [r.keep for r in got] == [True, True, True, False, True, False, False, False, False, True, True, True, True]
    e = B.expected(B.keep(scored(spark, [few]))).first()
    assert (e.n_blocks, e.n_kept, e.precision, e.unsure) == (3, 3, 0.0, True)


def test_hashed_bits(spark):
    words = ["nav", "post", "nav", "ünï"]
    got = spark.createDataFrame([(words,)], "w array<string>").select(B.hashed(F.col("w"), 64).alias("b")).first().b
    assert got == sorted({zlib.crc32(w.encode()) % 64 for w in words})


def test_trees_learn(spark):
    rnd = random.Random(5)
    rows = [(i, x := rnd.random(), y := rnd.random(), float(x + y > 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double, label double")
    out = B.score(B.train(df, ["x", "y"], rounds=10, depth=3), df, ["x", "y"]).collect()
    assert sum((r.p > 0.5) == (r.label > 0.5) for r in out) > 280


def test_text_features_of_odd_texts(spark):
    rows = [(0, ""), (1, "Sign up"), (2, "ALL CAPS: 12/05/2020 |"), (3, "中文 words, and; more.")]
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, t string").select("i", *E.text_features(F.col("t"))).collect()}
    assert got[0].log_chars == 0 and got[0].name_like == 1 and got[1].short_cta == 1 and got[1].starts_capital == 1
    assert (got[2].all_caps, got[2].dateish, got[2].has_separator, got[2].ends_sentence) == (1, 1, 1, 0) and got[3].commas_per_word == pytest.approx(1 / 4) and got[3].n_sentences == 1
    assert got[1].log_words == pytest.approx(math.log(3), abs=1e-6)


def test_registrable_domains(spark):
    rules = ("com", "uk", "co.uk", "*.ck", "!www.ck")
    cases = {"a.b.example.com": "example.com", "example.co.uk": "example.co.uk", "x.example.co.uk": "example.co.uk", "uk": "uk", "co.uk": "co.uk", "a.b.c.ck": "b.c.ck", "c.ck": "c.ck", "www.ck": "www.ck", "x.www.ck": "www.ck", "host.unknown": "host.unknown", "a.host.unknown": "host.unknown", "": ""}
    got = {r.h: r.d for r in spark.createDataFrame([(h,) for h in cases], "h string").select("h", E.registrable(F.col("h"), rules).alias("d")).collect()}
    assert got == cases


def test_quota_sample_equals_taking_one_by_one(spark):
    import hashlib

    rnd = random.Random(6)
    rows = [(i, rnd.choice("abc"), f"d{rnd.randint(0, 6)}") for i in range(120)]
    quotas = {"b": 9, "a": 30, "c": 4}
    got = {r.id for r in E.quota_sample(spark.createDataFrame(rows, "id long, kind string, domain string"), "kind", "domain", "id", quotas).collect()}
    want, used = set(), {}
    for kind, quota in quotas.items():
        left = quota
        for i, _, d in sorted((r for r in rows if r[1] == kind), key=lambda r: hashlib.md5(f"7-{r[0]}".encode()).hexdigest()):
            if left and used.get(d, 0) < 3:
                want.add(i)
                used[d] = used.get(d, 0) + 1
                left -= 1
    assert got == want


def test_care_and_gates_and_labels(spark):
    rows = [("fast", 5.0, "a")] * 4 + [("same", 60.0, "a")] * 11 + [("fine", 60.0, x) for x in "abcabcabcabc"]
    got = {r.r: r.flags for r in E.care(spark.createDataFrame(rows, "r string, s double, a string"), "r", "s", "a").collect()}
    assert got == {"fast": "fast", "same": "same_answer", "fine": ""}
    labels = spark.createDataFrame([('{"label": " ACCURATE"}',), ("[]",), (None,), ('{"label": 3}',)], "t string").select(E.label(F.col("t"), ("accurate",)).alias("l")).collect()
    assert [r.l for r in labels] == ["accurate", None, None, None]
    g = E.gates(spark.createDataFrame([(0.5,), (0.7,)], "x double"), (("x", ">=", 0.6), ("x", "<=", 0.5))).collect()
    assert [r.passed for r in g] == [True, False]


def test_metadata():
    html = """<head><title>T</title><meta name=description content=D><script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "Docs"}}, 5]}, {"@type": ["TechArticle"], "headline": "H", "author": [{"name": "A"}]}]}</script></head>
    <body><div itemscope itemtype="https://schema.org/Product/"><span itemprop="name">Pen</span><meta itemprop="color" content="red"><i itemprop="color">blue</i><div itemscope itemprop="offers"><b itemprop="price">3</b></div></div></body>"""
    page = Page(html)
    assert metadata.microdata(page) == [{"@type": "Product", "name": "Pen", "color": ["red", "blue"]}, {"@type": "", "price": "3"}]
    assert metadata.front_matter(page, "u") == {"url": "u", "title": "H", "description": "D", "type": "TechArticle", "author": "A", "breadcrumb": "Home > Docs"}
    assert metadata.page_kind(page) == "article" and metadata.page_kind(Page("<p>x")) is None
    assert metadata.page_kind(Page('<div itemscope itemtype="x/Question"><b itemprop="name">q</b></div>')) == "forum"
    only = Page('<title>T</title><div itemscope itemtype="x/Product"><b itemprop="name">Pen</b></div>')
    assert metadata.front_matter(only, None) == {"title": "Pen", "type": "Product"}


def test_layout_and_data_tables():
    grid = "<tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr>"
    page = Page(f"<body><table><tr><td><p>prose</p></td></tr></table><table>{grid}</table><nav><table>{grid}</table></nav><table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table><table><tr><td><table>{grid}</table></td></tr></table></body>")
    t = page.tags("table")
    assert [tables.is_layout(page, i) for i in t] == [True, False, False, False, True, False]
    assert [tables.is_data(page, Sums(page), i) for i in t] == [False, True, False, False, False, True]
    assert tables.unwrap_layout(page) == 2 and len(page.tags("table")) == 4
    deep = Page("<body>" + "<table><tr><td>" * 100 + "x")
    assert tables.unwrap_layout(deep) == 100 and not deep.tags("table", "td")


def test_templates_saved_and_selected(spark, tmp_path):
    from pagelens.operators import template

    rows = [("a.example/x", "s1", "t", 5, 1.0, 0.5, 40.0), ("a.example", "s2", "t", 5, 1.0, 0.5, 40.0), ("b.example/y", "s3", "t", 5, 1.0, 0.5, 40.0), ("b.example/z", "s4", "t", 5, 1.0, 0.5, 40.0)]
    template.save(spark.createDataFrame(rows, template.MODEL), str(tmp_path / "m"))
    models = template.load(spark, str(tmp_path / "m"))
    assert sorted(models.collect()) == sorted(spark.createDataFrame(rows, template.MODEL).collect())
    pages = spark.createDataFrame([(1, "https://a.example/x/1"), (2, "https://a.example/q/1"), (3, "https://b.example/q/1"), (4, "https://c.example/"), (5, "https://b.example/z/2")], "page_id long, url string")
    assert {r.page_id: r.group_key for r in template.select(pages, models).collect()} == {1: "a.example/x", 2: "a.example", 3: "b.example/y", 5: "b.example/z"}
