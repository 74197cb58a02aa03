"""Queries of the evaluation half, by name, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import words as W
from ..operators import evaluation as E
from ..operators import judge, statistics, template
from .catalog import _BM25, _DRAW, GRAMS, HOST, PATH, SITE_KEY, TERMS, TOKENS, WORDS, _bm25, _list, _visible, query, table

_NOISE = "regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1) || ' ' || array_to_string(regexp_extract_all(html, '(?is)<div class=\"ad\">(.*?)</div>', 1), ' ')"
_F = "round({b1} * (1 - z) * r / ({d} + 1e-9), 4)"
_SCORES = f"""v AS (SELECT page_id, {_visible("html")} AS o, {_visible("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)")} AS c, {_visible(f"({_NOISE})")} AS z FROM pages),
t AS (SELECT page_id, o, {TOKENS.format('o')} AS ot, {TOKENS.format('c')} AS ct, {TOKENS.format('z')} AS zt FROM v),
g AS (SELECT page_id, o, {GRAMS.format('ot')} AS og, {GRAMS.format('ct')} AS cg, {GRAMS.format('zt')} AS zg FROM t),
a AS (SELECT page_id, o, og, list_filter(cg, lambda x: NOT list_contains(zg, x)) AS c1, list_filter(zg, lambda x: NOT list_contains(cg, x)) AS z1 FROM g),
s AS (SELECT page_id, len(c1)::BIGINT AS n_content, len(z1)::BIGINT AS n_noise, coalesce(len(list_filter(c1, lambda x: list_contains(og, x))) / nullif(len(c1), 0)::DOUBLE, 0) AS r, coalesce(len(list_filter(z1, lambda x: list_contains(og, x))) / nullif(len(z1), 0)::DOUBLE, 0) AS z,
({" + ".join(f"(length(lower(o)) - length(replace(lower(o), '{k}', ''))) // {len(k)}" for k in W.NOISE_KEYWORDS)})::BIGINT AS noise_total, greatest(1, length(o) // 4) AS tokens FROM a),
scores AS (SELECT page_id, n_content, n_noise, round(r, 4) AS recall, round(z, 4) AS retention, noise_total, round(1000 * noise_total / tokens::DOUBLE, 3) AS noise_per_1k, {_F.format(b1=1.25, d="0.25 * r + (1 - z)")} AS f_precision, {_F.format(b1=5.0, d="4 * (1 - z) + r")} AS f_coverage, {_F.format(b1=2.0, d="r + (1 - z)")} AS f_balanced FROM s)"""


def _scores(spark, sf_dir):
    h = F.col("html")
    noise = F.concat_ws(" ", F.regexp_extract(h, "(?is)<nav[^>]*>(.*?)</nav>", 1), F.array_join(F.regexp_extract_all(h, F.lit('(?is)<div class="ad">(.*?)</div>'), F.lit(1)), " "))
    rows = table(spark, sf_dir, "pages").select("page_id", judge.visible_text(F.regexp_extract(h, "(?is)<article[^>]*>(.*)</article>", 1)).alias("content"), judge.visible_text(noise).alias("noise"), judge.visible_text(h).alias("output"))
    return E.extraction_scores(rows, "page_id", "content", "noise", "output")


@query(f"WITH {_SCORES} SELECT * FROM scores")
def extraction_scores(spark, sf_dir):
    """The plain-text baseline of every page against the anchors of its article and of its navigation and advertisements."""
    return _scores(spark, sf_dir)


GATES = (("recall", ">=", 0.6), ("f_balanced", ">=", 0.5), ("retention", "<=", 0.2))


@query(f"WITH {_SCORES} " + " UNION ALL ".join(f"SELECT '{c}' AS name, round(avg({c}), 6) AS value, {t}::DOUBLE AS threshold, round(avg({c}), 6) {op} {t} AS passed FROM scores" for c, op, t in GATES))
def qa_gates(spark, sf_dir):
    return E.gates(_scores(spark, sf_dir), GATES)


_HEADS = "len(regexp_extract_all(text, '(?m)^#{{{0}}}[ \\t]+\\S.*$'))::BIGINT"


@query("SELECT doc_id, length(text)::BIGINT AS chars, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens, " + _HEADS.format("1,6") + " AS headings, " + ", ".join(f"{_HEADS.format(k)} AS h{k}" for k in range(1, 7)) + ", len(regexp_extract_all(text, '\\[Table:'))::BIGINT AS tables, len(regexp_extract_all(text, '\\[Section:'))::BIGINT AS sections, starts_with(ltrim(text), '---') AS has_front_matter FROM documents WHERE text IS NOT NULL")
def output_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", *E.output_stats(F.col("text")))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)\A---\n.*?\n---\n', ''), '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\*\*([^*\n]+)\*\*', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g'), '[ \t]+\n', chr(10), 'g'), '(?i)(?:https?://|www\.)[^\s]+', '[link]', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def normalise_output(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(E.normalised(F.col("text"))).alias("digest"))


#: Public-suffix rules of the query; a full list is a parameter of `registrable`.
SUFFIXES = ("com", "net", "org", "uk", "co.uk", "*.ck", "!www.ck")


@query(f"SELECT page_id, regexp_extract(regexp_replace({HOST}, ':[0-9]+$', ''), '([^.]+\\.[^.]+|^[^.]*)$', 1) AS domain FROM pages")
def registrable_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", E.registrable(F.regexp_replace(U.host(F.col("url")), r":[0-9]+$", ""), SUFFIXES).alias("domain"))


QUOTAS = {"en": 20, "de": 15, "fr": 10, "es": 5}


def _quota_sql() -> str:
    parts = [f"p AS (SELECT {HOST} AS domain, page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '')[1] AS kind, md5('7-' || page_id) AS k FROM pages)", "t0 AS (SELECT kind, domain, page_id FROM p WHERE false)"]
    for i, (name, n) in enumerate(QUOTAS.items()):
        parts.append(f"""t{i + 1} AS (SELECT * FROM t{i} UNION ALL SELECT * FROM (SELECT kind, domain, page_id FROM (SELECT p.*, 3 - coalesce(u.n, 0) AS free, row_number() OVER (PARTITION BY p.domain ORDER BY k, page_id) AS r
FROM p LEFT JOIN (SELECT domain, count(*) AS n FROM t{i} GROUP BY 1) u ON p.domain = u.domain WHERE kind = '{name}') WHERE r <= free ORDER BY k, page_id LIMIT {n}))""")
    return "WITH " + ", ".join(parts) + f" SELECT * FROM t{len(QUOTAS)}"


@query(_quota_sql())
def quota_sample(spark, sf_dir):
    segs = F.filter(F.split(U.path(F.col("url")), "/"), lambda x: x != "")
    rows = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("domain"), F.get(segs, F.lit(0)).alias("kind"))
    return E.quota_sample(rows, "kind", "domain", "page_id", QUOTAS)


_U = _DRAW.format("'7-' || draw || '-' || doc_id") + " % 1000000"


@query(f"""WITH d AS (SELECT doc_id, (quality - toxic)::DOUBLE AS d FROM labels WHERE doc_id IS NOT NULL), w AS (SELECT draw, d, {_U} AS u FROM d, (SELECT unnest(generate_series(0, 99)) AS draw)),
m AS (SELECT draw, sum(w * d) / sum(w) AS m FROM (SELECT draw, d, (u >= 367879)::INT + (u >= 735759)::INT + (u >= 919699)::INT + (u >= 981012)::INT + (u >= 996340)::INT + (u >= 999406)::INT AS w FROM w) GROUP BY draw),
r AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS r FROM m) SELECT (SELECT round(avg(d), 6) FROM d) AS mean, (SELECT round(m, 6) FROM r WHERE r = 2) AS low, (SELECT round(m, 6) FROM r WHERE r = 97) AS high""")
def paired_bootstrap(spark, sf_dir):
    """Quality less toxicity of each labelled document, with an interval over resampled documents."""
    return E.poisson_bootstrap(table(spark, sf_dir, "labels").filter("doc_id is not null"), "doc_id", "quality", "toxic")


@query("""WITH k AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY ALL), t AS (SELECT user_id, max(k) AS top FROM k GROUP BY 1), p AS (SELECT user_id, count(*)::BIGINT AS n_items, round(median(value), 6) AS median_seconds FROM events GROUP BY 1)
SELECT user_id, n_items, median_seconds, round(top / n_items::DOUBLE, 6) AS top_share, concat_ws(',', CASE WHEN median_seconds < 30 THEN 'fast' END, CASE WHEN n_items >= 10 AND top / n_items::DOUBLE >= 0.9 THEN 'same_answer' END) AS flags FROM p JOIN t USING (user_id)""")
def rater_care(spark, sf_dir):
    """Users of the event table as raters: their values as seconds, their event types as answers."""
    return E.care(table(spark, sf_dir, "events"), "user_id", "value", "event_type")


@query("SELECT event_type, count(*)::BIGINT AS n, round(median(value), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def speed_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(F.percentile("value", p), 6).alias(a) for p, a in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"))], F.round(F.avg("value"), 6).alias("mean"))


_LABELS = ("accurate", "incorrect", "missing")
_SAID = "CASE doc_id % 5 WHEN 0 THEN '{{\"label\": \" Accurate \", \"reason\": \"r\"}}' WHEN 1 THEN '{{\"label\": \"incorrect\"}}' WHEN 2 THEN 'not json' WHEN 3 THEN '{{\"label\": \"other\"}}' ELSE '{{\"label\": \"MISSING\"}}' END"


@query("WITH s AS (SELECT quality, CASE doc_id % 5 WHEN 0 THEN 'accurate' WHEN 1 THEN 'incorrect' WHEN 4 THEN 'missing' END AS label FROM labels) SELECT quality, label, count(*)::BIGINT AS n, round(avg(CASE label WHEN 'accurate' THEN 1 WHEN 'incorrect' THEN -1 WHEN 'missing' THEN 0 END), 6) AS score FROM s GROUP BY ALL")
def judge_labels(spark, sf_dir):
    """Labels parsed from judges' JSON, one made up for each labelled document, counted and scored by its quality."""
    said = table(spark, sf_dir, "labels").select("quality", F.expr(_SAID.format()).alias("said")).withColumn("label", E.label(F.col("said"), _LABELS))
    worth = F.when(F.col("label") == "accurate", 1).when(F.col("label") == "incorrect", -1).when(F.col("label") == "missing", 0)
    return said.groupBy("quality", "label").agg(F.count("*").alias("n"), F.round(F.avg(worth), 6).alias("score"))


@query(f"""WITH {_BM25}, c AS (SELECT item_id, doc_id, rank, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM top JOIN documents USING (doc_id)),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT item_id, doc_id, rank, tokens, least(tokens, 1200 - before)::BIGINT AS used FROM b WHERE before < 1200""")
def context_cap(spark, sf_dir):
    """The best documents of each benchmark item up to 1,200 tokens, the last one cut."""
    top, _ = _bm25(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", W.token_estimate(F.col("text")).alias("tokens"))
    return E.capped_context(top.join(docs, "doc_id"), "item_id", "rank", "tokens").select("item_id", "doc_id", "rank", "tokens", F.col("used").cast("long").alias("used"))


_GOLD = f"array_to_string({TERMS.format('text')}[1:4], ' ')"


@query(f"""WITH {_BM25}, a AS (SELECT item_id, {_GOLD} AS gold FROM benchmark WHERE len({TERMS.format('text')}) >= 4), f AS (SELECT doc_id, array_to_string({TERMS.format('text')}, ' ') AS flat FROM documents)
SELECT item_id, gold, bool_or(contains(flat, gold)) AS found FROM a JOIN top USING (item_id) JOIN f USING (doc_id) GROUP BY ALL""")
def gold_in_top5(spark, sf_dir):
    """Whether one of the five best documents of an item holds its answer, here its first four words."""
    top, _ = _bm25(spark, sf_dir)
    flat = lambda n: F.array_join(F.slice(W.terms(F.col("text")), 1, n) if n else W.terms(F.col("text")), " ")
    items = table(spark, sf_dir, "benchmark")
    gold = items.filter(F.size(W.terms(F.col("text"))) >= 4).select("item_id", flat(4).alias("gold"))
    asked = gold.join(top, "item_id").select("item_id", "gold", "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(asked) if items.count() <= 100_000 else asked, "doc_id")  # five rows of an item at most
    return docs.withColumn("flat", flat(0)).groupBy("item_id", "gold").agg(F.bool_or(F.contains("flat", F.col("gold"))).alias("found"))


@query("""WITH h AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1, regexp_extract(html, '(?is)<p>(.*?)</p>', 1) AS body FROM pages)
SELECT page_id, unnest(['plain', 'title', 'path']) AS variant, md5(unnest([body, title || chr(10) || body, title || ' > ' || h1 || chr(10) || body])) AS digest FROM h""")
def heading_variants(spark, sf_dir):
    """What is embedded of a page's first paragraph: alone, below the title, and below its heading path."""
    of = lambda tag: F.trim(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    h = table(spark, sf_dir, "pages").select("page_id", of("title").alias("title"), of("h1").alias("h1"), F.regexp_extract("html", "(?is)<p>(.*?)</p>", 1).alias("body"))
    path = F.concat_ws(" > ", "title", "h1")
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), F.md5(v).alias("digest")) for k, v in (("plain", F.col("body")), ("title", F.concat_ws("\n", "title", "body")), ("path", F.concat_ws("\n", path, "body")))])
    return h.select("page_id", F.explode(rows).alias("r")).select("page_id", "r.*")


@query("""WITH p AS (SELECT page_id, html, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS k, lower(regexp_extract(html, '(?is)<html[^>]*\\slang=["'']?([A-Za-z\\-]*)', 1)) AS lang FROM pages)
SELECT page_id, CASE WHEN json_valid(html) THEN 'json_body' WHEN lang <> '' AND NOT starts_with(lang, 'en') THEN 'not_english' WHEN row_number() OVER (PARTITION BY k ORDER BY page_id) > 1 THEN 'duplicate_url' ELSE 'ok' END AS reason FROM p""")
def page_filter(spark, sf_dir):
    """The first reason to leave a page out: a JSON body, another language, an address that a page with a smaller id has."""
    h = F.col("html")
    lang = F.lower(F.regexp_extract(h, r"""(?is)<html[^>]*\slang=["']?([A-Za-z\-]*)""", 1))
    p = table(spark, sf_dir, "pages").select("page_id", U.page_key(F.col("url")).alias("k"), F.try_parse_json(h).isNotNull().alias("json"), lang.alias("lang"))
    first = p.groupBy("k").agg(F.min("page_id").alias("first"))  # a group's smallest id, without ranking its rows in one task
    reason = F.when(F.col("json"), "json_body").when((F.col("lang") != "") & ~F.startswith("lang", F.lit("en")), "not_english").when(F.col("page_id") > F.col("first"), "duplicate_url").otherwise("ok")
    return p.join(first, "k").select("page_id", reason.alias("reason"))


_T = {
    "log_chars": "ln(1 + length(text))", "log_words": "ln(1 + n)", "avg_word_len": "length(array_to_string(w, '')) / n1", "upper_frac": "len(regexp_extract_all(text, '\\p{Lu}')) / greatest(1, len(regexp_extract_all(text, '\\p{L}')))::DOUBLE",
    "digit_frac": "len(regexp_extract_all(text, '[0-9]')) / c1", "punct_frac": "len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]')) / c1", "ends_sentence": "regexp_matches(text, '[.!?\"''”’)]\\s*$')::INT::DOUBLE",
    "n_sentences": "least(10, len(regexp_extract_all(text, '[.!?][''\")\\]]?(?:\\s|$)')))::DOUBLE", "commas_per_word": "len(regexp_extract_all(text, ',')) / n1", "stopword_frac": f"len(list_filter(l, lambda x: list_contains({_list(E.STOPWORDS)}, x))) / n1",
    "all_caps": "(regexp_matches(text, '\\p{L}') AND NOT regexp_matches(text, '\\p{Ll}'))::INT::DOUBLE", "starts_capital": "regexp_matches(text, '^\\p{Lu}')::INT::DOUBLE", "has_separator": "regexp_matches(text, '[|•»·©]')::INT::DOUBLE",
    "dateish": f"regexp_matches(text, '{E.DATE_LIKE}')::INT::DOUBLE", "name_like": "(n <= 4 AND len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))) = n)::INT::DOUBLE", "ends_colon": "regexp_matches(text, ':\\s*$')::INT::DOUBLE",
    "chrome_word_frac": f"len(list_filter(l, lambda x: list_contains({_list(E.CHROME_WORDS)}, x))) / n1", "starts_cta_verb": f"coalesce(list_contains({_list(E.CALL_VERBS)}, l[1]), false)::INT::DOUBLE", "short_cta": f"(coalesce(list_contains({_list(E.CALL_VERBS)}, l[1]), false) AND n <= 6)::INT::DOUBLE",
}


@query("WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l, len(w) AS n, greatest(1, len(w))::DOUBLE AS n1, greatest(1, length(text))::DOUBLE AS c1 FROM w) SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _T.items()) + " FROM n")
def text_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", *E.text_features(F.col("text")))


@query()
def site_folds(spark, sf_dir):
    """One of five folds for each page, by its site's CRC-32."""
    return table(spark, sf_dir, "pages").select("page_id", F.pmod(F.crc32(U.host(F.col("url"))), F.lit(5)).alias("fold"))


_SHINGLES = f"w AS (SELECT page_id, {SITE_KEY} AS grp, ({WORDS.format(_visible('html'))})[1:4000] AS t FROM pages), g AS (SELECT page_id, grp, list_sort({GRAMS.format('t')}) AS g FROM w)"


@query(f"WITH {_SHINGLES} SELECT page_id, len(g)::BIGINT AS n_shingles, md5(array_to_string(g, '|')) AS digest FROM g")
def page_shingles(spark, sf_dir):
    g = template.shingles(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(g).cast("long").alias("n_shingles"), F.md5(F.array_join(F.array_sort(g), "|")).alias("digest"))


@query(f"""WITH {_SHINGLES}, s AS (SELECT min(page_id) AS id, grp, g FROM g WHERE len(g) > 0 GROUP BY grp, g), e AS (SELECT id, grp, unnest(g) AS k, len(g) AS n FROM s),
o AS (SELECT x.id AS a, y.id AS b, count(*) AS o, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.grp = y.grp AND x.k = y.k AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(o / (na + nb - o), 6) AS jaccard FROM o WHERE 100 * o >= 80 * (na + nb - o)""")
def page_near_duplicates(spark, sf_dir):
    return template.near_pages(table(spark, sf_dir, "pages"))


@query("""WITH m AS (SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang), v AS (SELECT CASE WHEN quality > toxic THEN 'ours' WHEN quality < toxic THEN 'theirs' ELSE 'tie' END AS w, (n_chars + 1) / (floor(m) + 1) AS r FROM documents JOIN labels USING (doc_id) JOIN m USING (lang)),
b AS (SELECT w, unnest(['all', CASE WHEN r > 1.1 THEN 'longer' WHEN r < 1 / 1.1::DOUBLE THEN 'shorter' ELSE 'similar' END]) AS band FROM v)
SELECT band, count(*)::BIGINT AS n, sum((w = 'ours')::INT)::BIGINT AS wins, sum((w = 'theirs')::INT)::BIGINT AS losses, sum((w = 'tie')::INT)::BIGINT AS ties, round((sum((w = 'ours')::INT) - sum((w = 'theirs')::INT)) / count(*)::DOUBLE, 3) AS net FROM b GROUP BY band""")
def length_bands(spark, sf_dir):
    """Labels as verdicts, by a document's length against its language's mean."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mean = d.groupBy("lang").agg(F.floor(F.avg("n_chars")).alias("m"))
    q = F.col("quality")
    verdict = F.when(q > F.col("toxic"), "ours").when(q < F.col("toxic"), "theirs").otherwise("tie")
    return statistics.length_bands(d.select("doc_id", "lang", "n_chars").join(labels, "doc_id").join(mean, "lang").withColumn("w", verdict), "n_chars", "m", "w")


@query()
def landing_pages(spark, sf_dir):
    return E.landing_pages(table(spark, sf_dir, "pages"))
