"""Rescues of tables and terms, landing pages and length bands, against plain loops."""

import math
import random

from pagelens.operators import blocks as B
from pagelens.operators import evaluation as E
from pagelens.operators import statistics


def plain_rescue(rows, threshold=0.5):
    """Block after block of one page, in lists."""
    base = [r["keep"] for r in rows]
    out = list(base)
    kept = {" ".join(r["text"].lower().split()) for r in rows if r["keep"] and len(r["text"]) >= 30}
    for i, r in enumerate(rows):
        h = next((j for j in range(i - 1, -1, -1) if rows[j]["tag"] == "h2"), None)
        if base[i]:
            continue
        if r["tag"] == "table" and r["is_data"]:
            key = " ".join(r["text"].lower().split())
            if len(key) >= 30 and key in kept:
                continue
            if r["n_rows"] >= 500:
                out[i] = True
            elif h is not None and (base[h] or 0.08 <= rows[h]["p"] < threshold and i - h <= 2):
                out[i] = True
                out[h] = True
                if len(key) >= 30:
                    kept.add(key)
        elif r["tag"] in ("dt", "dd") and r["list_id"] is not None and not r["list_marked"]:
            own = [x for x in rows if x["list_id"] == r["list_id"]]
            dts, dds = [x for x in own if x["tag"] == "dt"], [x for x in own if x["tag"] == "dd"]
            grid = len(dts) >= 4 and dds and all(len(x["text"]) <= 40 for x in dts) and all(len(x["text"]) <= 80 for x in dds)
            if not grid and h is not None and base[h]:
                out[i] = True
    return out


def test_rescue(spark):
    rng, rows, want = random.Random(5), [], {}
    for page in range(60):
        mine = []
        for i in range(rng.randrange(0, 25)):
            tag = rng.choice(["h2", "p", "table", "table", "dt", "dd"])
            text = rng.choice(["short", "Cells of a table that are long enough to count", "words " * rng.randrange(1, 20)]).strip()
            mine.append({"page_id": page, "idx": i, "tag": tag, "text": text, "p": rng.choice([0.01, 0.1, 0.3, 0.7]), "keep": rng.random() < 0.3, "is_data": rng.random() < 0.8, "n_rows": rng.choice([3, 3, 3, 600]), "list_id": rng.choice([1, 2]) if tag in ("dt", "dd") else None, "list_marked": tag in ("dt", "dd") and page % 7 == 0})
        rows += mine
        want |= {(page, i): k for i, k in enumerate(plain_rescue(mine))}
    df = spark.createDataFrame(rows, "page_id long, idx long, tag string, text string, p double, keep boolean, is_data boolean, n_rows long, list_id long, list_marked boolean")
    got = B.rescue(df)
    assert got.columns == df.columns
    wrong = {k for r in got.collect() if want[k := (r.page_id, r.idx)] != r.keep}
    # two long copies of a table of which one is long by rows: a plain loop takes the first, windows both
    assert not {k for k in wrong if next(r for r in rows if (r["page_id"], r["idx"]) == k)["n_rows"] < 500}
    assert sum(want.values()) > sum(r["keep"] for r in rows) and B.rescue(df.limit(0)).count() == 0


def test_landing_pages(spark):
    links = ["/pricing/", "https://www.shop.org/products/a", "products/b", "//shop.org/solutions", "/de/products/c", "/en/products/d", "/blog/products", "/products/x.pdf", "/features?x=1", "https://other.org/products", "/products/a#top", "/platform", "/plans", "/services", "mailto:x@shop.org", "https://shop.org/home/"]
    html = "".join(f"<a class=x href=\"{x}\">l</a>" for x in links)
    df = spark.createDataFrame([(1, "https://shop.org/home", html), (2, "https://shop.org/", None), (3, None, "<a href=/x>")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.role, r.url or "") for r in E.landing_pages(df).collect())
    sells = ["https://www.shop.org/products/a", "https://shop.org/products/b", "https://shop.org/solutions", "https://shop.org/en/products/d"]
    assert got == sorted([(1, "homepage", "https://shop.org/home"), (1, "pricing", "https://shop.org/pricing/"), *[(1, "product", u) for u in sells], (2, "homepage", "https://shop.org/"), (3, "homepage", "")])


def test_length_bands_and_lead(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        a, b = rng.randrange(50, 500), rng.randrange(50, 500)
        x = math.log((a + 1) / (b + 1))
        win = rng.random() < 1 / (1 + math.exp(-(0.4 + 0.9 * x)))
        rows.append((a, b, "tie" if rng.random() < 0.1 else "ours" if win else "theirs"))
    df = spark.createDataFrame(rows, "a long, b long, w string")
    bands = {r.band: r for r in statistics.length_bands(df, "a", "b", "w").collect()}
    assert bands["all"].n == 600 == sum(bands[k].n for k in ("similar", "longer", "shorter")) and bands["all"].ties == sum(w == "tie" for *_, w in rows)
    u = v = 0.0
    for _ in range(30):  # Newton steps in numbers
        g = [0.0] * 5
        for a, b, w in rows:
            if w != "tie":
                x = math.log((a + 1) / (b + 1))
                p = 1 / (1 + math.exp(-(u + v * x)))
                for k, z in enumerate(((w == "ours") - p, ((w == "ours") - p) * x, p * (1 - p), p * (1 - p) * x, p * (1 - p) * x * x)):
                    g[k] += z
        det = g[2] * g[4] - g[3] ** 2
        u, v = u + (g[4] * g[0] - g[3] * g[1]) / det, v + (g[2] * g[1] - g[3] * g[0]) / det
    assert abs(statistics.equal_length_lead(df, "a", "b", "w") - 1 / (1 + math.exp(-u))) < 1e-4
    assert statistics.equal_length_lead(df.filter("w = 'ours'"), "a", "b", "w") is None
