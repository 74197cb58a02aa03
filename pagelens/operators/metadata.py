"""What a page says about itself: JSON-LD, microdata, head tags, breadcrumb and kind."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..html import Page

# Schema types that describe a page, those of them that describe a site instead, and types that tell a page's kind.
DESCRIBED = ("TechArticle", "Article", "NewsArticle", "WebPage", "Product", "SoftwareApplication", "FAQPage", "HowTo", "BreadcrumbList", "Organization", "WebSite")
SITE_WIDE = ("BreadcrumbList", "Organization", "WebSite")
ARTICLE_TYPES = frozenset({"Article", "NewsArticle", "BlogPosting", "TechArticle"})
FORUM_TYPES = frozenset({"DiscussionForumPosting", "QAPage", "Question", "Answer", "Comment"})


def json_ld(page: Page) -> list[dict]:
    """Objects of all JSON-LD scripts, graphs opened; a script with several objects in a row is read as a list, a broken one is left out."""
    out: list[dict] = []
    for i in page.tags("script", root=-1):
        if "ld+json" not in page.attrs[i].get("type", ""):
            continue
        raw = "".join(page.text[j] for j in range(i + 1, int(page.end[i]) + 1))
        for attempt in (raw, f"[{raw}]"):
            try:
                found = json.loads(attempt)
            except (ValueError, RecursionError):
                continue
            for x in found if isinstance(found, list) else [found]:
                if isinstance(x, dict):
                    graph = x.get("@graph")
                    out += [y for y in (graph if isinstance(graph, list) else [graph] if isinstance(graph, dict) else [x]) if isinstance(y, dict)]
            break
    return out


def microdata(page: Page) -> list[dict]:
    """One object for each itemscope with a property: its type's last part, and values from content, href or text; a property that
    occurs again makes a list. What stands in an inner scope is that scope's."""
    scopes = [i for i in page.tags(root=-1) if "itemscope" in page.attrs[i]]
    inner = set(scopes)
    out = []
    for s in scopes:
        item: dict = {}
        skip = -1
        for i in page.tags(root=s)[1:]:
            if i <= skip:
                continue
            if i in inner:
                skip = int(page.end[i])
                continue
            a = page.attrs[i]
            for name in a.get("itemprop", "").split():
                value = a.get("content") or a.get("href") or page.get_text(i)
                if name in item:
                    item[name] = [*(item[name] if isinstance(item[name], list) else [item[name]]), value]
                else:
                    item[name] = value
        if item:
            out.append({"@type": page.attrs[s].get("itemtype", "").rstrip("/").rsplit("/", 1)[-1], **item})
    return out


def kind_of(item: dict) -> str:
    t = item.get("@type", "")
    return str(t[0] if isinstance(t, list) and t else "" if isinstance(t, list) else t)


def _first(item: dict, *names: str) -> str:
    return next((str(item[k][0] if isinstance(item[k], list) else item[k]) for k in names if item.get(k) and not isinstance(item[k], dict)), "")


def breadcrumb(items: list[dict]) -> str:
    for x in items:
        if kind_of(x) == "BreadcrumbList":
            steps = x.get("itemListElement")
            names = []
            for step in steps if isinstance(steps, list) else []:
                if isinstance(step, dict):
                    inner = step.get("item")
                    names.append(str(step.get("name") or (inner.get("name") if isinstance(inner, dict) else "") or ""))
            return " > ".join(n for n in names if n)
    return ""


#: The character references that head_title() decodes, one after another.
REFERENCES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"))


def head_title(html: Column) -> Column:
    """The markup of the first title element with REFERENCES decoded, all others as they stand; blanks collapsed and taken off the ends."""
    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    for name, sign in REFERENCES:
        title = F.replace(title, F.lit(name), F.lit(sign))
    return F.regexp_replace(F.regexp_replace(title, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def front_matter(page: Page, url: str | None) -> dict:
    """url, title, description, type, lastUpdated, author and breadcrumb: of the first object that describes the page, in JSON-LD, then in
    microdata, else of the first JSON-LD object; what it lacks comes from the head."""
    linked = json_ld(page)
    items = linked + microdata(page)
    best = next((x for x in items if kind_of(x) in DESCRIBED and kind_of(x) not in SITE_WIDE), linked[0] if linked else {})
    metas = {(page.attrs[i].get("name") or page.attrs[i].get("property", "")).lower(): page.attrs[i].get("content", "") for i in page.tags("meta", root=-1)}
    head = page.first("title")
    who = best.get("author")
    who = who[0] if isinstance(who, list) and who else who
    out = {
        "url": url or "",
        "title": _first(best, "headline", "name", "title") or (page.get_text(head) if head is not None else "") or metas.get("og:title", ""),
        "description": _first(best, "description") or metas.get("description", ""),
        "type": kind_of(best),
        "lastUpdated": _first(best, "dateModified", "datePublished", "lastUpdated"),
        "author": str(who.get("name") or "") if isinstance(who, dict) else "" if isinstance(who, list) else str(who or ""),
        "breadcrumb": breadcrumb(items),
    }
    return {k: v for k, v in out.items() if v}


def page_kind(page: Page) -> str | None:
    """forum or article, by schema types and by a single article element with a main heading."""
    types = {kind_of(x) for x in json_ld(page) + microdata(page)}
    if types & FORUM_TYPES:
        return "forum"
    articles = page.tags("article", root=-1)
    if len(articles) == 1 and page.tags("h1", root=articles[0]) or types & ARTICLE_TYPES:
        return "article"
    return None
