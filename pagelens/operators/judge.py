"""Judgements of pages, hosts and texts: language, safety, quality and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import words as W

# Function words. Words that English shares are left out of the other lists.
STOPWORDS = {
    "en": "the of and to in a is that for it as with was on be by this are at from or an have not but they his her you we can all will their has more one if there been which when who would what about so out up your were than into them its our also only other some these may do how new",
    "da": "og i er det en af til at de den for med som på ikke et har vi kan du om",
    "de": "der die das und ist von den mit für auf nicht ein eine zu im dem sich auch werden wir",
    "es": "el la los las de que y en del se por con para una un es lo como más pero sus",
    "fi": "ja on ei että se oli ovat tai kun myös mutta sekä tämä jos kuin niin voi",
    "fr": "le la les de des et est une un du pour dans que qui sur pas au avec nous vous",
    "id": "yang dan di dengan untuk dari ini itu pada ke dalam tidak atau akan kami anda",
    "it": "il la di che e per del della con le gli un una sono nella non più dei al",
    "nl": "de het een van en is dat op te zijn voor met niet aan er om ook naar wij",
    "no": "og i er det en av til at de som på ikke et har vi kan du for med",
    "pl": "w i na z do nie jest się że to od po dla oraz przez jak",
    "pt": "o a os as de que e em do da para com um uma não por mais dos das",
    "sv": "och i är det en av till att de som på inte ett har vi kan du för med",
    "tr": "ve bir bu için ile da de olarak daha çok en gibi kadar sonra",
}
# Endings and words of hosts, and vocabularies of texts, that count as unsafe.
RISKY_ENDINGS = "xyz top club icu buzz site online click link work gq tk ml cf ga loan win bid mom"
RISKY_HOSTS = r"casino|bet\d|\dbet|betting|gambl|poker|slot|lotto|porn|xxx|sex|escort|hentai|jav|torrent|warez|pharma|pills?\b|\d{2,}"
RISKY_TEXTS = {
    "gambling": "casino casinos betting sportsbook jackpot poker roulette baccarat gambling",
    "adult": "porn porno xxx nude nudes escort escorts hentai onlyfans",
    "piracy": "torrent torrents warez keygen cracked",
}
# Markers of script-rendered pages, in order.
ROOT_MARKERS = ('id="root"', "id='root'", 'id="app"', "id='app'", 'id="__next"', "id='__next'", 'id="__nuxt"', "data-reactroot", "ng-version=")


def _count_in(words: Column, vocabulary: str) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(vocabulary.split()))).cast("long")


def own_words(stopwords: dict[str, str] = STOPWORDS) -> dict[str, list[str]]:
    """Each other language's words that say something: none that English has, no single letters, no web ending."""
    english = set(stopwords["en"].split())
    return {k: [w for w in dict.fromkeys(v.split()) if len(w) > 1 and w != "com" and w not in english] for k, v in sorted(stopwords.items()) if k != "en"}


def language_words(text: Column) -> Column:
    """Words of a text without addresses."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\S*(?:://|www\.|@)\S*|\S+\.(?:com|org|net)\b\S*", " ")
    return F.regexp_extract_all(F.lower(bare), F.lit(r"\p{L}+"), F.lit(0))


def language(docs: DataFrame, id: str, text: str, stopwords: dict[str, str] = STOPWORDS) -> DataFrame:
    """(id, n_words, non_latin, english, best_other, best_other_count, reason): the share of letters outside Latin script, words of each
    language's list, and why a text of 40 words or more is not English: a quarter of its letters, or ten words of another list and more
    than of the English one. One pass over a text's words leaves those of any list; only these are counted by language."""
    other = own_words(stopwords)
    seen = docs.select(id, language_words(F.col(text)).alias("w"))
    known = sorted({w for v in other.values() for w in v} | set(stopwords["en"].split()))
    letters = F.array_join("w", "")
    seen = seen.select(id, F.size("w").cast("long").alias("n_words"), F.length(letters).alias("letters"), F.length(F.regexp_replace(letters, r"\p{IsLatin}", "")).alias("foreign"), F.filter("w", lambda w: w.isin(known)).alias("k"))
    counts = seen.select(id, "n_words", F.round(F.coalesce(F.try_divide("foreign", "letters"), F.lit(0.0)), 4).alias("non_latin"), _count_in(F.col("k"), stopwords["en"]).alias("english"), *[_count_in(F.col("k"), " ".join(v)).alias(f"_{k}") for k, v in other.items()])
    best = F.greatest(*[F.col(f"_{k}") for k in other]) if len(other) > 1 else F.col(f"_{next(iter(other))}")
    name = F.coalesce(*[F.when(F.col(f"_{k}") == F.col("best_other_count"), k) for k in other])
    out = counts.withColumn("best_other_count", best).withColumn("best_other", name)
    script = (F.col("n_words") >= 40) & (F.col("non_latin") >= 0.25)
    foreign = (F.col("n_words") >= 40) & (F.col("best_other_count") >= 10) & (F.col("best_other_count") > F.col("english"))
    return out.select(id, "n_words", "non_latin", "english", "best_other", "best_other_count", F.when(script, "non_english_script").when(foreign, "non_english_stopwords").alias("reason"))


def host_reason(url: Column) -> Column:
    h = F.regexp_replace(U.host(url), r":\d+$", "")
    ending = F.element_at(F.split(h, r"\."), -1)
    return F.when(ending.isin(RISKY_ENDINGS.split()), "risky_domain_ending").when(h.rlike(RISKY_HOSTS), "risky_domain_name")


def text_category(text: Column, least: int = 3) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    out = None
    for name, vocabulary in RISKY_TEXTS.items():
        hit = _count_in(words, vocabulary) >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def visible_text(html: Column) -> Column:
    """Text of a page by expressions alone: hidden containers, comments and tags out, blanks collapsed; entities as written."""
    x = html
    for tag in ("script", "style", "noscript", "svg", "template", "title"):
        x = F.regexp_replace(x, rf"(?is)<{tag}[\s>].*?</{tag}>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


def input_quality(pages: DataFrame) -> DataFrame:
    """(page_id, visible_chars, visible_words, script_chars, root_marker, is_thin, likely_js_shell)."""
    text = visible_text(F.col("html"))
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    marker = F.coalesce(*[F.when(F.contains(F.lower("html"), F.lit(m)), m) for m in ROOT_MARKERS])
    out = pages.select("page_id", F.length(text).cast("long").alias("visible_chars"), F.size(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]{2,}"), F.lit(0))).cast("long").alias("visible_words"), F.aggregate(scripts, F.lit(0), lambda a, s: a + F.length(s)).cast("long").alias("script_chars"), marker.alias("root_marker"), F.col("html").rlike("(?i)<noscript").alias("hint"))
    thin = (F.col("visible_chars") < 280) | (F.col("visible_words") < 40)
    heavy = (F.col("script_chars") >= 0.35 * (F.col("script_chars") + F.col("visible_chars"))) & (F.col("visible_chars") < 800) & (F.col("script_chars") > 0)
    return out.withColumn("is_thin", thin).withColumn("likely_js_shell", thin & (F.col("root_marker").isNotNull() | F.col("hint") | heavy)).drop("hint")


def acceptance(pages: DataFrame, least: int = 80) -> DataFrame:
    """(page_id, reason): the first rule that a page fails, else ok."""
    lang = F.lower(F.regexp_extract("html", r"""(?is)<html[^>]*\slang=["']?([A-Za-z\-]*)""", 1))
    words = F.size(F.regexp_extract_all(visible_text(F.col("html")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return pages.select("page_id", F.when(~lang.startswith("en"), "not_english").when(words < least, "too_few_words").otherwise("ok").alias("reason"))
