"""Parsing, cleaning, Markdown and chunks on small pages."""

import random
import re

import pytest

from pagelens.config import Config
from pagelens.html import Page, Sums
from pagelens.operators import chunks, extract, nodes, template

FILL = " ".join(f"Sentence number {i} says something of its own about the matter at hand." for i in range(30))


def test_unclosed_tags_and_early_end():
    p = Page("<html><body><p><b>one<br>two<p>three</body></html><ul><li>a<li>b</ul><script>var t='</p>'</script>")
    assert [p.tag[i] for i in p.tags(root=-1)] == ["html", "body", "p", "b", "br", "p", "ul", "li", "li", "script"]
    assert p.get_text(1).startswith("one two three a b")


def test_sums_equal_plain_walk():
    random.seed(3)
    for _ in range(60):
        html = "".join(random.choice(["<div>", "</div>", "<p>", "</p>", "<a href='#'>", "</a>", " word ", "x", "<ul><li>", "</ul>"]) for _ in range(40))
        p = Page(html)
        s = Sums(p)
        for i in p.tags(root=-1):
            assert s.text_len(i) == len(p.get_text(i))
            links = [p.get_text(a) for a in p.tags("a", root=i)]
            if p.get_text(i):
                assert s.link_density(i) == pytest.approx(min(1.0, len(" ".join(links)) / len(p.get_text(i))))


def test_node_table_removal_and_lengths(spark):
    pages = spark.createDataFrame([(1, "<body><div>ab<span>c</span></div><script>x</script><p> d e </p></body>"), (2, None), (3, "")], "page_id long, html string")
    from pyspark.sql import functions as F

    t = nodes.without(nodes.nodes(pages), F.col("tag") == "script")
    got = {(r.page_id, r.tag): r.text_len for r in nodes.text_lengths(t).collect()}
    assert got == {(1, "body"): 8, (1, "div"): 4, (1, "span"): 1, (1, "p"): 3}


def test_markdown():
    html = f"""<html><head><title>T</title></head><body><nav class="menu"><a href="/">Home</a></nav><main><h1>Title</h1><p>{FILL}</p><h2>Part</h2>
    <ul><li>first item of the list here<ul><li>inner item of the list</li></ul></li></ul><table><tr><th>k</th><th>v</th></tr><tr><td>a|b</td><td>1</td></tr></table>
    <pre>x = 1\ny = 2</pre><div style="display:none">secret</div></main><footer>Imprint and so on</footer></body></html>"""
    x = extract.extract(html, "https://example.com/a")
    assert x["root"] == "main"
    for part in ("# Title", "## Part", "| k | v |", "| a\\|b | 1 |", "```\nx = 1\ny = 2\n```", "title: T"):
        assert part in x["markdown"]
    for gone in ("Home", "Imprint", "secret"):
        assert gone not in x["body"]


def test_noise_phrase_and_presets():
    html = f"<body><article><p>{FILL}</p><p>Accept all cookies and manage cookie preferences</p></article></body>"
    assert "Accept all" not in extract.extract(html)["body"]
    with pytest.raises(ValueError):
        Config.of("balanced", nonsense=1)
    assert Config.of("coverage").min_chars < Config.of("balanced").min_chars < Config.of("precision").min_chars
    assert Config.of("balanced", min_chars=7).with_page_type("docs").min_chars == 7


@pytest.mark.parametrize("html", [None, "", "no tags", "<div>" * 20_000 + "deep", "<table><tr><td>" * 500, "<p>\ud83d".encode("utf-8", "replace").decode(), "<![x", "&#xd800;<p>a"])
def test_robust(html):
    extract.extract(html)


def test_chunks_keep_every_word():
    random.seed(1)
    for _ in range(50):
        parts = []
        for k in range(random.randint(1, 12)):
            parts.append(random.choice([f"{'#' * random.randint(1, 4)} head{k}", " ".join(f"w{k}x{j}" for j in range(random.randint(1, 220))), "```\ncode a b\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |"]))
        md = "\n\n".join(parts)
        out = chunks.chunk(md, "t")
        body = [w for kind, v in chunks.blocks(md) if kind != "heading" for w in v.split()]
        assert [w for c in out for w in c["text"].split()] == body
        assert [c["index"] for c in out] == list(range(len(out)))


def test_templates(spark):
    rows = [(i, f"https://s.example.com/x/{i}", f"<body><nav class='top'><a href='/'>Home page</a> <a href='/b'>About our company and its people</a></nav><p>{i} {FILL}</p></body>") for i in range(9)]
    pages = spark.createDataFrame([*rows, (99, rows[0][1], rows[0][2])], "page_id long, url string, html string")
    found = template.mine(pages).collect()
    assert [(r.group_key, r.page_hits, r.frequency) for r in found] == [("s.example.com/x", 9, 1.0)]
    out = extract.extract_pages(pages, templates=template.mine(pages), prune=False, link_blocks=False)
    assert not out.filter("markdown like '%About our company%'").count()


def test_nothing_of_a_very_large_page_is_dropped():
    p = Page("<body>" + "<p>x" * 260_000 + "<div>the last words</div>")
    assert len(p) > 500_000 and p.get_text(0).endswith("x the last words")


BAD = ['<script type="application/ld+json">{"@graph": null}</script><p>words here</p>', '<script type="application/ld+json">{"@graph": 5, "headline": "H"}</script>', '<ol start="²"><li>one item of a list</li></ol>', '<ol start="99999999999999999999"><li>x</li></ol>', '<script type="application/ld+json">[[[1]]]</script>', '<table><tr><td colspan="x">1</td></tr></table>']


def test_bad_pages_are_rows(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "https://a.example/x", h) for i, h in enumerate([*BAD, None, ""])], "page_id long, url string, html string")
    assert extract.extract_pages(pages).filter("exists(warnings, w -> w like 'failed%')").count() == 0
    assert extract.extract_pages(pages).count() == len(BAD) + 2
    broken = spark.createDataFrame([(1, None, "<p>" + FILL), (2, None, "<p>" + FILL)], "page_id long, url string, html string")

    def bad(body, title):
        raise KeyError("no")

    monkeypatch.setattr(extract, "chunk", bad)
    got = extract.extract_pages(broken, spread=False)
    assert [r.warnings for r in got.collect()] == [["failed: KeyError"]] * 2 or got.count() == 2


@pytest.mark.parametrize("tag,attrs,inner,most,want", [
    ("div", "", "words", 100, False),
    ("nav", "", "Home About", 100, True),
    ("nav", "", "x" * 8001, 100, False),
    ("menu", "", "x" * 9000, 100, True),
    ("div", "class='site-footer'", "Imprint", 100, True),
    ("div", "class='promo'", "x" * 101, 100, False),
    ("div", "role='search'", "Find", 100, True),
    ("div", "role='search'", "x" * 100, 100, False),
    ("div", "class='sidebar'", "<main>all of it</main>", 100, False),
    ("section", "class='related menu'", f"<p>{'long prose ' * 9}</p>" * 2, 900, False),
])
def test_furniture_table(tag, attrs, inner, most, want):
    page = Page(f"<body><{tag} {attrs}>{inner}</{tag}><p>rest</p></body>")
    assert extract.is_furniture(page, Sums(page), page.tags(tag)[0], most) is want


def test_header_of_an_article_stays():
    page = Page("<body><article><header><h1>Title</h1></header><p>text</p></article><header><a href='/'>Home</a></header></body>")
    own, site = page.tags("header")
    assert not extract.is_furniture(page, Sums(page), own, 4000) and extract.is_furniture(page, Sums(page), site, 4000)


def test_signature_formats():
    import hashlib

    page = Page("<body><nav class='b A' id='Top' role='Navigation'>x</nav><div>only its own text of some length</div><div>short</div><main>m</main></body>")
    a, b, c = (template.signature(page, i) for i in (*page.tags("nav"), *page.tags("div")))
    sha = lambda key: hashlib.sha1(key.encode()).hexdigest()[:16]
    text = hashlib.md5(b"only its own text of some length").hexdigest()[:12]
    assert (a, b, c) == (sha("nav|id=top|class=a.b|role=navigation"), sha(f"div|texthash={text}"), None)
    assert template.signature(page, page.tags("main")[0]) is None


def test_packed_chunks():
    rnd = random.Random(7)
    for _ in range(60):
        text = "\n".join(" ".join(rnd.choice(["word", "a-b", "é", "12", "!!"]) for _ in range(rnd.choice([0, 3, 30, 90]))) for _ in range(rnd.randint(0, 8)))
        out = chunks.packed(text, 25)
        assert " ".join(out).split() == text.split()
        assert all(len(re.findall("[a-z0-9]+", c.lower())) <= 26 for c in out)


def test_pages_apart(spark):
    body = "<body><p>" + " ".join(f"word{i}" for i in range(200)) + "{}</p></body>"
    rows = [(1, "https://s.example/x/1", body.format("")), (2, "https://s.example/x/2", body.format(" more")), (3, "https://s.example/x/3", body.format("")), (4, "https://s.example/y/4", body.format("")), (5, "https://s.example/x/5", "<p>another text altogether here</p>"), (6, "https://s.example/x/6", None), (7, "https://s.example/x/7", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [(r.a, r.b) for r in template.near_pages(pages).collect()] == [(1, 2)]
    assert {r.page_id for r in template.apart(pages).collect()} == {1, 4, 5, 6, 7}


def test_templates_of_pages_that_are_one(spark):
    rows = [(i, f"https://s.example.com/x/{i}", f"<body><nav class='top'><a href='/'>Home page</a> <a href='/b'>About our company and its people</a></nav><p>{i} {FILL}</p></body>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert template.mine(pages).count() == 1 and template.mine(pages, near_once=True).count() == 0
