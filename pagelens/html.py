"""Pages as flat preorder tables: element and text nodes numbered in document order, each with the last number of its subtree."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a start tag closes, up to the nearest of the tags that hold it back.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("body html td th table button article section div main li blockquote figure".split())


class _Builder(HTMLParser):
    def __init__(self, most_depth: int):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.text, self.parent, self.end, self.depth = [], [], [], [], [], []
        self.open: list[int] = []
        self.most_depth = most_depth

    def _add(self, tag: str, attrs: dict, text: str) -> int:
        if self.tag and not tag and self.text[-1] and not self.tag[-1] and self.parent[-1] == (self.open[-1] if self.open else -1):
            self.text[-1] += text  # one text node for a run of data
            return len(self.tag) - 1
        n = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.parent.append(self.open[-1] if self.open else -1)
        self.depth.append(len(self.open))
        self.end.append(n)
        return n

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            self.end[self.open.pop()] = len(self.tag) - 1

    def handle_starttag(self, tag, attrs):
        kinds, held = CLOSES.get(tag, (set(), set()))
        if tag in CLOSE_P:
            kinds, held = kinds | {"p"}, held | SCOPE
        for i in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[i]]
            if name in kinds:
                self._close(i)
                if name == "p" or tag not in ("thead", "tbody", "tfoot", "tr"):
                    break
            elif name in held:
                break
        n = self._add(tag, {k: v or "" for k, v in attrs}, "")
        if tag not in VOID and len(self.open) < self.most_depth:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.tag[self.open[-1]] == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[i]] == tag:
                if tag not in ("body", "html"):  # content after an early end still belongs to the body
                    self._close(i)
                return

    def handle_data(self, data):
        self._add("", {}, data)


class Page:
    """A parsed page; nodes are switched off by interval, never moved."""

    def __init__(self, html: str | None, most_depth: int = 2_000):
        b = _Builder(most_depth)
        try:
            b.feed(html or "")
            b.close()
        except (AssertionError, ValueError):  # what was read so far stands
            pass
        b._close(0)
        self.tag, self.attrs, self.text, self.parent, self.depth = b.tag, b.attrs, b.text, b.parent, b.depth
        self.end = np.array(b.end, np.int64)
        self.on = np.ones(len(self.tag), bool)

    def __len__(self) -> int:
        return len(self.tag)

    def off(self, i: int) -> None:
        self.on[i : self.end[i] + 1] = False

    def tags(self, *names: str, root: int = 0) -> list[int]:
        if not len(self):
            return []
        last = int(self.end[root]) if root >= 0 else len(self) - 1
        return [i for i in range(max(0, root), last + 1) if self.on[i] and self.tag[i] and (not names or self.tag[i] in names)]

    def first(self, *names: str) -> int | None:
        return next(iter(self.tags(*names, root=-1)), None)

    def pieces(self, i: int) -> list[str]:
        """Stripped texts below i that are switched on."""
        return [s for j in range(i, int(self.end[i]) + 1) if not self.tag[j] and self.on[j] and (s := self.text[j].strip())]

    def get_text(self, i: int, sep: str = " ") -> str:
        return sep.join(self.pieces(i))

    def children(self, i: int) -> list[int]:
        out, j = [], i + 1
        while j <= self.end[i]:
            if self.on[j]:
                out.append(j)
            j = int(self.end[j]) + 1
        return out

    def parents(self, i: int):
        while (i := self.parent[i]) >= 0:
            yield i

    def classes(self, i: int) -> list[str]:
        return self.attrs[i].get("class", "").split()

    def role(self, i: int) -> str:
        return self.attrs[i].get("role", "").lower()


class Sums:
    """Text and link lengths of every subtree, from running sums over the numbering."""

    def __init__(self, page: Page):
        self.page = page
        n = len(page)
        size = np.array([len(t.strip()) if not g and o else 0 for g, t, o in zip(page.tag, page.text, page.on)], np.int64) if n else np.zeros(0, np.int64)
        self.chars = np.concatenate([[0], np.cumsum(size)])
        self.count = np.concatenate([[0], np.cumsum(size > 0)])
        link = np.zeros(n, np.int64)
        mark = np.zeros(n, np.int64)
        for i in range(n):
            if page.on[i] and page.tag[i] == "a":
                link[i], mark[i] = self.text_len(i), 1
        self.link_chars, self.links = np.concatenate([[0], np.cumsum(link)]), np.concatenate([[0], np.cumsum(mark)])
        long = np.array([int(page.on[i] and page.tag[i] == "p" and self.text_len(i) >= 80) for i in range(n)], np.int64) if n else np.zeros(0, np.int64)
        self.long = np.concatenate([[0], np.cumsum(long)])
        main = np.array([int(page.on[i] and (page.tag[i] == "main" or page.role(i) == "main")) for i in range(n)], np.int64) if n else np.zeros(0, np.int64)
        self.main = np.concatenate([[0], np.cumsum(main)])

    def _of(self, sums: np.ndarray, i: int, inner: bool = False) -> int:
        return int(sums[self.page.end[i] + 1] - sums[i + inner])

    def text_len(self, i: int) -> int:
        return self._of(self.chars, i) + max(0, self._of(self.count, i) - 1)

    def bare_len(self, i: int) -> int:
        return self._of(self.chars, i)

    def link_density(self, i: int) -> float:
        n = self.text_len(i)
        links = self._of(self.links, i)
        return 1.0 if not n else min(1.0, (self._of(self.link_chars, i) + max(0, links - 1)) / n)

    def long_paragraphs(self, i: int) -> int:
        return self._of(self.long, i)

    def has_main(self, i: int) -> bool:
        return self._of(self.main, i, inner=True) > 0
