"""Language identification by word-first backoff.

A word that training saw is scored by its log frequency in each language; an unseen word falls back to its character 4-grams,
then 3-, 2- and 1-grams, and takes the longest that training saw. A text's language is the one with the largest sum.

Defined cases: a null text, or one without a letter, is `und` with score 0; a text whose words say nothing takes the language
with the most training rows; ties go to the language that sorts first; a null id is not held out and not trained on; repeated
rows are judged one by one; without any labelled row, or any word in them, everything is `und` (and a filter by
language rejects nothing, as nothing was learned to tell); texts of any length are judged whole; an empty table gives no rows; other columns of the input are left alone.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import chunked, column, mapped

LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
ORDERS = (4, 3, 2, 1)


def _words(chunk: str) -> list[str]:
    return WORD.findall(chunk.lower())


def _grams(word: str, n: int) -> list[str]:
    s = f"<{word}>" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)] or [s]


@dataclass
class Model:
    """All words and grams of the sample with their log frequencies in each language; the sample bounds them."""

    langs: list[str]
    prior: np.ndarray
    words: dict[str, int]
    rows: np.ndarray  # of words
    grams: dict[int, dict[str, tuple[float, ...]]]

    @classmethod
    def empty(cls) -> Model:
        return cls([], np.zeros(0), {}, np.zeros((0, 0)), {n: {} for n in ORDERS})

    def word_score(self, word: str) -> list[float] | None:
        if (i := self.words.get(word)) is not None:
            return self.rows[i].tolist()
        for n in ORDERS:
            if found := [v for v in map(self.grams[n].get, _grams(word, n)) if v]:
                return [sum(x) / len(found) for x in zip(*found)]
        return None


def _first_step(steps: list[tuple[int, int, int]], part: float, max_docs: int, max_chars: int) -> int:
    """The step of (step, rows, characters) from which on all are taken: highest first, as long as they keep to a part of both limits."""
    docs = chars = 0
    first = max(steps)[0]
    for step, n, c in sorted(steps, reverse=True):
        docs, chars = docs + n, chars + c
        if step != first and (docs > part * max_docs + 1e-6 or chars > part * max_chars):
            break
        first = step
    return first


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", *, where: Column | None = None, max_docs: int = 4_000, max_chars: int = 50_000_000, id: str = "doc_id", least_docs: int = 500) -> Model:
    """Learn from the labelled rows of docs; where more than about max_docs are labelled, from those whose id and text hash lowest.

    Each language has its share of max_docs, or least_docs rows where that is more (all rows, if it has fewer), and as great a part of
    max_chars; hashes are counted in 16 steps an octave, and the steps from the lowest on are taken, one at least, that keep to both. All
    words and grams of the sample are learned, so the sample bounds the model. A language without a counted word is not predicted.
    Without an id column, rows of one text are taken or left together.
    """
    keys = ["id"] if id in docs.columns else []
    rows = (docs if where is None else docs.filter(where)).select(*[F.col(id).alias("id") for _ in keys], F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    step = F.floor(16 * (52 - F.log2(F.pmod(F.xxhash64(*keys, "text"), F.lit(1 << 52)) + 1))).cast("int")
    rows = rows.withColumn("step", step)
    steps: dict[str, list[tuple[int, int, int]]] = {}
    for r in rows.groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect():  # at most 833 for a language
        steps.setdefault(r.lang, []).append((r.step, r.n, r.chars))
    per = {la: sum(n for _, n, _ in found) for la, found in steps.items()}
    langs, total = sorted(per), sum(per.values())
    if not total:
        return Model.empty()
    first = {la: _first_step(found, max(per[la] / total, least_docs / max_docs), max_docs, max_chars) for la, found in steps.items()}
    rows = rows.filter(F.col("step") >= F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in chunked(batches):
            counts: dict[tuple[str, str], int] = {}
            for t, la in zip(column(batch, "text"), column(batch, "lang")):
                for w in _words(t):
                    counts[la, w] = counts.get((la, w), 0) + 1
            yield {"lang": [k[0] for k in counts], "w": [k[1] for k in counts], "n": list(counts.values())}

    def grams(batches):
        for batch in batches:
            counts: dict[tuple[str, int, str], int] = {}
            for la, w, n in zip(column(batch, "lang"), column(batch, "w"), column(batch, "n")):
                for k in ORDERS:
                    for g in _grams(w, k):
                        counts[la, k, g] = counts.get((la, k, g), 0) + n
            yield {"lang": [k[0] for k in counts], "k": [k[1] for k in counts], "w": [k[2] for k in counts], "n": list(counts.values())}

    words = mapped(rows, count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).persist()
    heard = {r.lang for r in words.select("lang").distinct().collect()}
    langs = [la for la in langs if la in heard]
    if not langs:
        words.unpersist()
        return Model.empty()
    of = lambda df, kinds: df.groupBy(*kinds, "w").agg(*[F.sum(F.when(F.col("lang") == la, F.col("n")).otherwise(0)).alias(f"n{i}") for i, la in enumerate(langs)])
    sums = lambda df, kinds: df.agg(*[F.sum(f"n{i}") for i in range(len(langs))]) if not kinds else df.groupBy(*kinds).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))])
    tables: dict[int, tuple[list[str], np.ndarray]] = {}
    w = of(words, [])
    g = of(mapped(words, grams, "lang string, k int, w string, n long"), ["k"]).persist()
    try:
        totals = {0: sums(w, []).first(), **{r.k: r[1:] for r in sums(g, ["k"]).collect()}}
        for k in (0, *ORDERS):
            every = (w if k == 0 else g.filter(F.col("k") == k).drop("k")).toPandas()
            n = every.drop(columns="w").to_numpy(np.float64).reshape(len(every), len(langs))
            all_n = np.array([x or 0 for x in totals.get(k, [0] * len(langs))], np.float64)
            tables[k] = every["w"].tolist(), np.log((n + 0.5) / (all_n + 0.5 * (len(every) + 1)))
    finally:
        words.unpersist()
        g.unpersist()
    prior = np.log(np.array([per[la] for la in langs], np.float64) / total)
    seen, rows_of = tables[0]
    return Model(langs, prior, {w: i for i, w in enumerate(seen)}, rows_of, {k: dict(zip(tables[k][0], map(tuple, tables[k][1].tolist()))) for k in ORDERS})


class _Seen(dict):
    """From a piece of text between blanks to its row of scores; forgets all beyond its limit."""

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((1 << 12, max(1, len(model.langs))))

    def __missing__(self, piece: str) -> int:
        scores = [v for w in _words(piece) if (v := self.model.word_score(w)) is not None]
        if (n := len(self)) == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        if scores:
            self.rows[n] = scores[0] if len(scores) == 1 else [sum(x) for x in zip(*scores)]
        self[piece] = n
        return n


class Predictor:
    def __init__(self, model: Model, limit: int = 150_000):
        self.model, self.limit, self.seen = model, limit, _Seen(model)

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs or not LETTER.search(text):
            return "und", 0.0
        if len(self.seen) > self.limit:
            self.seen = _Seen(self.model)
        ids = np.fromiter(map(self.seen.__getitem__, pieces := text.split()), np.int64, len(pieces))
        s = self.seen.rows[ids].sum(axis=0) + self.model.prior
        i = int(np.argmax(s))
        return self.model.langs[i], 1.0 / float(sum(math.exp(max(-700.0, x - s[i])) for x in s))


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; only text is looked at."""
    said = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit

    def run(batches):
        judge = Predictor(said.value)
        for batch in chunked(batches):
            got = [judge(t) for t in column(batch, "text")]
            yield {"id": batch.column(0), "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of at least `least`; all rows, where no language was learned."""
    if not model.langs:
        return docs
    said = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Predictor(said.value)
        for batch in chunked(batches, text):
            mask = [la != "und" and s >= least for la, s in map(judge, column(batch, text))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(4)) == 2, F.lit(False))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, where=~held_out())
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
