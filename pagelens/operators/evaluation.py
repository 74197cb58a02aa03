"""Scores of extractions, checks of raters, chunks for retrieval and statistics of outputs, as columns and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import words as W
from .statistics import draw


def extraction_scores(rows: DataFrame, id: str, content: str, noise: str, output: str) -> DataFrame:
    """(id, n_content, n_noise, recall, retention, noise_total, noise_per_1k, f_precision, f_coverage, f_balanced) of an output text.

    Anchors are the 5-grams of the content and of the noise that the other does not have."""
    grams = lambda c: W.grams(W.tokens(F.col(c)))
    out = F.col(output)
    g = rows.select(id, grams(content).alias("c"), grams(noise).alias("z"), grams(output).alias("o"), W.token_estimate(out).alias("tokens"), sum((W.mentions(out, k) for k in W.NOISE_KEYWORDS[1:]), W.mentions(out, W.NOISE_KEYWORDS[0])).alias("noise_total"))
    g = g.select("*", F.array_except("c", "z").alias("c1"), F.array_except("z", "c").alias("z1"))
    share = lambda a: F.coalesce(F.try_divide(F.size(F.array_intersect("o", a)), F.size(a)), F.lit(0.0))
    s = g.select(id, F.size("c1").cast("long").alias("n_content"), F.size("z1").cast("long").alias("n_noise"), share("c1").alias("r"), share("z1").alias("z"), "noise_total", F.round(1000 * F.col("noise_total") / F.greatest(F.lit(1), "tokens"), 3).alias("noise_per_1k"))
    r, clean, tiny = F.col("r"), 1 - F.col("z"), 1e-9
    weighed = lambda b: F.round((1 + b) * clean * r / ((b * r + clean if b < 1 else b * clean + r) + tiny), 4)
    return s.select(id, "n_content", "n_noise", F.round(r, 4).alias("recall"), F.round(F.col("z"), 4).alias("retention"), "noise_total", "noise_per_1k", weighed(0.25).alias("f_precision"), weighed(4.0).alias("f_coverage"), weighed(1.0).alias("f_balanced"))


def gates(scores: DataFrame, limits: tuple[tuple[str, str, float], ...]) -> DataFrame:
    """(name, value, threshold, passed) of the average of each column of scores: limits are (column, '>=' or '<=', threshold)."""
    one = scores.agg(*[F.round(F.avg(c), 6).alias(c) for c in dict.fromkeys(c for c, _, _ in limits)])
    rows = [F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.lit(float(t)).alias("threshold"), (F.col(c) >= t if op == ">=" else F.col(c) <= t).alias("passed")) for c, op, t in limits]
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def output_stats(text: Column) -> list[Column]:
    """Characters, tokens, headings in all and by level, markers and front matter of a Markdown text."""
    heads = lambda marks: F.size(F.regexp_extract_all(text, F.lit(rf"(?m)^#{{{marks}}}[ \t]+\S.*$"), F.lit(0))).cast("long")
    marker = lambda m: F.size(F.regexp_extract_all(text, F.lit(rf"\[{m}:"), F.lit(0))).cast("long")
    return [F.length(text).cast("long").alias("chars"), W.token_estimate(text).alias("tokens"), heads("1,6").alias("headings"), *[heads(str(k)).alias(f"h{k}") for k in range(1, 7)], marker("Table").alias("tables"), marker("Section").alias("sections"), F.ltrim(text).startswith("---").alias("has_front_matter")]


def normalised(text: Column) -> Column:
    """A Markdown text as raters see it: no front matter, images, link targets or emphasis; addresses as [link]."""
    x = F.coalesce(text, F.lit(""))
    for pattern, put in (
        (r"(?s)\A---\n.*?\n---\n", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\*\*([^*\n]+)\*\*", "$1"),
        (r"\*([^*\n]+)\*", "$1"),
        (r"[ \t]+\n", "\n"),
        (r"(?i)(?:https?://|www\.)[^\s]+", "[link]"),
        (r"\n{3,}", "\n\n"),
    ):
        x = F.regexp_replace(x, pattern, put)
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def registrable(host: Column, rules: tuple[str, ...]) -> Column:
    """A host's registrable domain by public-suffix rules: plain ones, *.wildcards and !exceptions; a host that is a suffix is its own."""
    plain = [r for r in rules if r[0] not in "*!"]
    wild = [r[2:] for r in rules if r.startswith("*.")]
    odd = [r[1:] for r in rules if r.startswith("!")]
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    rest = lambda i: F.array_join(F.slice(labels, i, n), ".")
    # the first label from which on the host is a suffix; an exception's own suffix starts one label later
    starts = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(rest(i).isin(odd) & (i < n), i + 1).when(rest(i).isin(plain), i).when((i < n) & rest(i + 1).isin(wild), i))
    first = F.coalesce(F.array_min(starts), n)
    return F.when(n == 0, "").when(first <= 1, F.array_join(labels, ".")).otherwise(rest(first - 1))


def quota_sample(rows: DataFrame, kind: str, domain: str, id: str, quotas: dict[str, int], most: int = 3, seed: int = 7) -> DataFrame:
    """(kind, domain, id): kinds in order, rows in order of their md5, each taken while its kind's quota lasts and its domain has fewer
    than `most` rows over all kinds. One small pass for each kind: within it, a row is in reach if fewer than the domain's free places
    come before it, and of these the first `quota` are taken, which is what taking one row after the other would give."""
    taken = None
    key = F.md5(F.concat_ws("-", F.lit(seed), F.col(id)))
    for name, quota in quotas.items():
        pool = rows.filter(F.col(kind) == name).select(kind, domain, id, key.alias("key"))
        used = taken.groupBy(domain).agg(F.count("*").alias("used")) if taken is not None else None
        pool = pool.join(used, domain, "left").withColumn("free", most - F.coalesce("used", F.lit(0))) if used is not None else pool.withColumn("free", F.lit(most))
        near = pool.withColumn("r", F.row_number().over(Window.partitionBy(domain).orderBy("key", id))).filter(F.col("r") <= F.col("free"))
        own = near.orderBy("key", id).limit(quota).select(kind, domain, id)
        taken = own if taken is None else taken.union(own)
    return taken


def poisson_bootstrap(pairs: DataFrame, id: str, a: str, b: str, draws: int = 100, seed: int = 7) -> DataFrame:
    """(mean, low, high) of a - b over paired rows: in every draw a row counts as often as a Poisson number of its own says, so that no
    draw has to look rows up; the interval is read from the sorted means of the draws."""
    u = draw(F.concat_ws("-", F.lit(seed), "draw", F.col(id)), F.lit(1_000_000))
    steps = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406)
    weight = sum(((u >= s).cast("int") for s in steps[1:]), (u >= steps[0]).cast("int"))
    rows = pairs.select(id, (F.col(a) - F.col(b)).cast("double").alias("d"))
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", weight)
    means = each.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    ranked = means.agg(F.array_sort(F.collect_list("m")).alias("m"))  # one number for each draw
    low, high = int(0.025 * draws), min(draws - 1, int(0.975 * draws))
    ci = ranked.select(F.round(F.get("m", F.lit(low)), 6).alias("low"), F.round(F.get("m", F.lit(high)), 6).alias("high"))
    return rows.agg(F.round(F.avg("d"), 6).alias("mean")).crossJoin(ci)  # one row each


def care(ratings: DataFrame, rater: str, seconds: str, answer: str, *, least_seconds: float = 30, least_items: int = 10, most_same: float = 0.9) -> DataFrame:
    """(rater, n_items, median_seconds, top_share, flags): raters who are fast, or give one answer nearly always."""
    top = ratings.groupBy(rater, answer).agg(F.count("*").alias("k")).groupBy(rater).agg(F.max("k").alias("top"))
    per = ratings.groupBy(rater).agg(F.count("*").alias("n_items"), F.round(F.median(seconds), 6).alias("median_seconds")).join(top, rater)
    share = F.col("top") / F.col("n_items")
    flags = F.concat_ws(",", F.when(F.col("median_seconds") < least_seconds, "fast"), F.when((F.col("n_items") >= least_items) & (share >= most_same), "same_answer"))
    return per.select(rater, "n_items", "median_seconds", F.round(share, 6).alias("top_share"), flags.alias("flags"))


def label(text: Column, valid: tuple[str, ...]) -> Column:
    """A judge's label from its JSON: one of the valid ones, else null."""
    said = F.lower(F.trim(F.coalesce(F.get_json_object(text, "$.label"), F.lit(""))))
    return F.when(said.isin(*valid), said)


def capped_context(ranked: DataFrame, query: str, rank: str, tokens: str, most: int = 1200) -> DataFrame:
    """The rows of each query by rank while fewer than `most` tokens stand before them, with the tokens that are used: the last is cut."""
    before = F.sum(tokens).over(Window.partitionBy(query).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1))
    out = ranked.withColumn("before", F.coalesce(before, F.lit(0)))
    return out.filter(F.col("before") < most).withColumn("used", F.least(F.col(tokens), most - F.col("before"))).drop("before")


# Stopwords, words of page furniture, verbs of calls to action, and what looks like a date.
STOPWORDS = "the of and to in a is that for it as with was on be by this are at from or an have not but they his her you we can all will their has more one if there been which when who would what about so out up your were than into them its our also only other some these may do how new"
CHROME_WORDS = "cookie cookies privacy subscribe newsletter copyright reserved share follow comment comments reply login signup sign register posted tags tag related menu search home contact terms policy facebook twitter linkedin instagram pinterest youtube email print advertisement sponsored read more click here download app cart checkout wishlist shipping returns account"
CALL_VERBS = "get schedule contact sign join learn shop book request start try see view download subscribe watch find explore buy add read talk call apply register login log create build discover compare check order claim reserve browse visit follow share tweet pin email print save"
DATE_LIKE = r"(?i)\b(\d{1,2}[:/.\-]\d{1,2}([:/.\-]\d{2,4})?|jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)\b"


def text_features(text: Column) -> list[Column]:
    """The nineteen numbers that describe a block's text."""
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    low = F.transform(words, lambda w: F.lower(w))
    n, chars, letters = F.size(words), F.greatest(F.lit(1), F.length(text)), F.greatest(F.lit(1), count(r"\p{L}"))
    some = F.greatest(F.lit(1), n)
    share = lambda vocabulary: F.size(F.filter(low, lambda w: w.isin(vocabulary.split()))) / some
    call = F.coalesce(F.get(low, F.lit(0)).isin(CALL_VERBS.split()), F.lit(False))
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    named = {
        "log_chars": F.log1p(F.length(text)),
        "log_words": F.log1p(n),
        "avg_word_len": F.length(F.array_join(words, "")) / some,
        "upper_frac": count(r"\p{Lu}") / letters,
        "digit_frac": count("[0-9]") / chars,
        "punct_frac": count(r"[^\p{L}\p{N}\s]") / chars,
        "ends_sentence": bit(text.rlike(r"""[.!?"'”’)]\s*$""")),
        "n_sentences": F.least(F.lit(10), count(r"""[.!?]['")\]]?(?:\s|$)""")).cast("double"),
        "commas_per_word": count(",") / some,
        "stopword_frac": share(STOPWORDS),
        "all_caps": bit(text.rlike(r"\p{L}") & ~text.rlike(r"\p{Ll}")),
        "starts_capital": bit(text.rlike(r"^\p{Lu}")),
        "has_separator": bit(text.rlike("[|•»·©]")),
        "dateish": bit(text.rlike(DATE_LIKE)),
        "name_like": bit((n <= 4) & (F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) == n)),
        "ends_colon": bit(text.rlike(r":\s*$")),
        "chrome_word_frac": share(CHROME_WORDS),
        "starts_cta_verb": bit(call),
        "short_cta": bit(call & (n <= 6)),
    }
    return [F.round(v, 6).alias(k) for k, v in named.items()]


# Paths of pages that sell, of those that do not, of locales, and of files.
PRICING_PATH = r"(?i)(^|/)(pricing|plans)(/|$|\.)"
PRODUCT_PATH = r"(?i)(^|/)(products?|platform|solutions?|features?|services|capabilities|industries|use-cases)(/|$)"
OTHER_PATH = r"(?i)(^|/)(docs?|documentation|developers?|api|blog|news|press|newsroom|careers?|jobs|login|log-in|signin|sign-in|signup|sign-up|register|account|legal|privacy|terms|cookie|support|help|community|events?|webinars?|resources|investors?|contact|search)(/|$)"
LOCALE_PATH = r"(?i)^/([a-z]{2})(-[a-z]{2})?(/|$)"
FILE_PATH = r"(?i)\.(pdf|png|jpe?g|gif|svg|zip|mp4|xml|json)$"


def site_of(netloc: Column) -> Column:
    """The last two labels of a host, without its port."""
    labels = F.split(F.substring_index(F.lower(netloc), ":", 1), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.least(F.lit(2), F.size(labels))), ".")


def landing_pages(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", most_products: int = 4) -> DataFrame:
    """(id, role, url): each page as a homepage, and of its links in document order the first to prices and the first `most_products` to
    products, on its own site, without query, file, foreign locale, or path of another kind; a trailing slash makes no other page.

    Links are absolute, of the same scheme, of the same host, or relative to the page's folder; dots in paths are left as they are."""
    base = pages.select(F.col(id).alias("id"), F.col(url).alias("home"), F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"'#]+)"), F.lit(1))).alias("at", "href"))
    scheme, netloc = F.regexp_extract("home", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), U.netloc(F.col("home"))
    folder = F.concat(F.lit("/"), F.regexp_extract(U.path(F.col("home")), r"^/?(.*/)?", 1))
    href = F.trim("href")
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(scheme, F.lit("://"), netloc, href))
        .otherwise(F.concat(scheme, F.lit("://"), netloc, folder, href))
    )
    links = base.select("id", "home", "at", whole.alias("link"))
    to, path = F.col("link"), U.path(F.col("link"))
    locale = F.lower(F.regexp_extract(path, LOCALE_PATH, 1))
    fit = to.rlike("(?i)^https?://") & ~F.contains(to, F.lit("?")) & ~path.rlike(FILE_PATH) & (site_of(U.netloc(to)) == site_of(U.netloc(F.col("home")))) & locale.isin("", "en", "us") & ~path.rlike(OTHER_PATH)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    role = F.when(path.rlike(PRICING_PATH), "pricing").when(path.rlike(PRODUCT_PATH), "product")
    found = links.filter(fit & (bare(to) != bare(F.col("home")))).select("id", "at", to.alias("url"), bare(to).alias("key"), role.alias("role"), path.rlike(PRODUCT_PATH).alias("sells")).filter("role is not null")
    once = found.groupBy("id", "key").agg(F.min_by(F.struct("at", "url", "role", "sells"), "at").alias("x")).select("id", "x.*")
    price = F.row_number().over(Window.partitionBy("id", "role").orderBy("at"))
    # a second page of prices is a product, where its path says so
    once = once.withColumn("role", F.when((F.col("role") == "pricing") & (price > 1), F.when(F.col("sells"), "product")).otherwise(F.col("role"))).filter("role is not null")
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("id", "role").orderBy("at"))).filter((F.col("role") == "pricing") | (F.col("r") <= most_products))
    return pages.select(F.col(id).alias("id"), F.lit("homepage").alias("role"), F.col(url).alias("url")).unionByName(ranked.select("id", "role", "url")).withColumnRenamed("id", id)
