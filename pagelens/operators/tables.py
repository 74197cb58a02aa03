"""Which tables hold data, and which only lay a page out."""

from __future__ import annotations

import re

from ..html import Page, Sums

# Fixed values.
NUMERIC = re.compile(r"[\s$€£¥]?\s*-?\d[\d,]*(?:\.\d+)?\s*%?\s*")
PARTS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption")
BLOCKS = ("div", "section", "article", "p", "ul", "ol", "table", "pre", "blockquote", "dl", "form", "h1", "h2", "h3", "h4", "h5", "h6")
FURNITURE = frozenset({"nav", "aside", "footer"})
WIDE_CELL, DEEPEST, LINKS_IN_TEXT, LINKS_PER_CELL = 300, 80, 0.20, 0.25


def own(page: Page, i: int, *names: str) -> list[int]:
    """Parts of a table that are not of a table inside it."""
    return [j for j in page.tags(*names, root=i) if j != i and next((p for p in page.parents(j) if page.tag[p] == "table"), -1) == i]


def is_layout(page: Page, i: int) -> bool:
    """A table with another inside, or one without heads or caption of which a cell holds a block or more than 300 characters."""
    if any(j != i for j in page.tags("table", root=i)):
        return True
    if own(page, i, "th", "caption", "thead"):
        return False
    return any(len(page.get_text(c)) > WIDE_CELL or any(page.tag[j] in BLOCKS for j in page.tags(root=c)[1:]) for c in own(page, i, "td"))


def unwrap_layout(page: Page, root: int = 0) -> int:
    """Parts of layout tables become plain divisions; outer tables are judged before inner ones. How many tables did."""
    tables = page.tags("table", root=root)
    depth = {i: sum(page.tag[p] == "table" for p in page.parents(i)) for i in tables}
    deep = max(depth.values(), default=0) >= DEEPEST
    layout = [i for i in tables if deep or is_layout(page, i)]
    parts = [j for i in layout for j in (i, *own(page, i, *PARTS[1:]))]
    for j in parts:
        page.tag[j] = "div"
    return len(layout)


def is_data(page: Page, sums: Sums, i: int) -> bool:
    """Two rows and two columns at least, a head or a number in a cell, outside of furniture, and few links."""
    if any(page.tag[p] in FURNITURE for p in page.parents(i)):
        return False
    rows = [[c for c in page.children(r) if page.tag[c] in ("td", "th")] for r in own(page, i, "tr")]
    cells = [c for r in rows for c in r]
    if len([r for r in rows if r]) < 2 or max(map(len, rows), default=0) < 2:
        return False
    if not any(page.tag[c] == "th" or NUMERIC.fullmatch(page.get_text(c)) for c in cells):
        return False
    links = len(page.tags("a", root=i))
    return links <= LINKS_PER_CELL * len(cells) and sums.link_density(i) <= LINKS_IN_TEXT
