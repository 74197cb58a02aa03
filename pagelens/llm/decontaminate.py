"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton over the items' words is built once, its words are streamed through it, and at each word the length of the longest
run that also occurs in an item is known. A run of `window` words (or a whole item, where the item is shorter) is a hit.

Items are taken in blocks of at most `block_words` words (or one item), and each block is one automaton that goes to the executors, one
pass over all documents for each, so that neither driver nor executors hold two; more items mean more passes, never a cut.

Defined cases: a null text has no words, no hits and the digest of nothing; an item without words never occurs; equal items all
count as occurring; an empty documents table gives no rows, an empty benchmark no hits; texts of any length are streamed
whole; rows that repeat an id are judged one by one; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunked, column, mapped, materialize, texts

#: Words of items in one automaton, which takes about 1.5 kB for each of them in a Python worker.
BLOCK = 100_000

#: Lower-case A-Z; whatever is neither an ASCII letter or digit nor a byte from 0x80 up is a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Automaton:
    """Generalised suffix automaton over word sequences, with the items whose windows end in each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(k, [self.ids.setdefault(w, len(self.ids)) for w in ws]) for k, ws in items if ws]
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        n = len(self.length)
        self.whole: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        self.items: list[set[str]] = [set() for _ in range(n)]
        for k, seq in items:
            state = 0
            for i, w in enumerate(seq):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.items[state].add(k)
            if len(seq) < window:
                self.whole[state].append((len(seq), k))
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):  # an item that holds a state's longest run holds its suffixes too
            if self.length[self.link[v]] >= window:
                self.items[self.link[v]] |= self.items[v]
        for v in order:
            self.whole[v] = self.whole[v] + self.whole[self.link[v]]
        self.shortest = min([window, *(len(s) for _, s in items)], default=window)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:  # the run is there already, from another item
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.length)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        c = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of hit words in order, merged, and the items that occur."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        known = np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= self.shortest:  # a word that no item has ends every match
                self._run(ids[a:b].tolist(), a, spans, found)
        return spans, found

    def _run(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        nxt, link, length, window, v, n = self.next, self.link, self.length, self.window, 0, 0
        for i, w in enumerate(ids, base + 1):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            if n < self.shortest:
                continue
            hit = 0
            if n >= window:
                hit, u = window, v
                while length[link[u]] >= window:
                    u = link[u]
                found |= self.items[u]
            for m, k in self.whole[v]:
                if m <= n:
                    hit = max(hit, m)
                    found.add(k)
            if hit:
                a = i - hit
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))


def automata(benchmark: DataFrame, id: str = "item_id", text: str = "text", *, window: int = 13, block_words: int = BLOCK) -> Iterator[Automaton]:
    """One automaton for every block of items."""
    block, size = [], 0
    for k, t in benchmark.select(F.col(id).cast("string"), F.col(text)).toLocalIterator():
        ws = words((t or "").encode())
        if block and size + len(ws) > block_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((k, ws))
        size += len(ws)
    yield Automaton(block, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[Automaton, Iterator[Automaton] | None]:
    """The first block's automaton, and an iterator over all where there are more."""
    machines = automata(benchmark, window=window, block_words=block_words)
    first, second = next(machines), next(machines, None)
    return first, None if second is None else itertools.chain([first, second], machines)


def _hits(keyed: DataFrame, machines: Iterator[Automaton]) -> DataFrame:
    """(hit_row, spans, items) of the rows with hits of a written table (hit_row, text): one pass for each block of items, so that an
    executor holds one automaton at a time."""
    kinds = "hit_row long, spans array<array<long>>, items array<string>"

    def scanner(said):
        def run(batches):
            for batch in chunked(batches):
                got = [said.value.scan(words(t)) for t in texts(batch)]
                yield {"hit_row": column(batch, "hit_row"), "spans": [[list(s) for s in x[0]] for x in got], "items": [sorted(x[1]) for x in got]}

        return run

    sc = keyed.sparkSession.sparkContext
    found = [materialize(mapped(keyed.select("hit_row", "text"), scanner(sc.broadcast(m)), kinds).filter("size(spans) > 0"), "hits") for m in machines]
    one = functools.reduce(DataFrame.union, found).groupBy("hit_row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))

    def merge(batches):
        for batch in batches:
            yield {"hit_row": column(batch, "hit_row"), "spans": [[list(x) for x in _merged([tuple(y) for y in s])] for s in column(batch, "s")], "items": column(batch, "i")}

    return mapped(one, merge, kinds)


def find(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", *, window: int = 13, share: float = 0.05, block_words: int = BLOCK) -> DataFrame:
    """(id, n_words, n_hit, n_items, items array, spans array, contaminated) of every row; spans are [first word, past the last)."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    first, more = _blocks(benchmark, window, block_words)
    said = None
    if more is None:
        said = docs.sparkSession.sparkContext.broadcast(first)
    else:
        keyed = materialize(rows.withColumn("hit_row", F.monotonically_increasing_id()), "rows")
        rows = keyed.join(_hits(keyed, more), "hit_row", "left")

    def run(batches):
        for batch in chunked(batches):
            ws = [words(t) for t in texts(batch)]
            if said is not None:
                got = [said.value.scan(w) for w in ws]
                spans, items = [x[0] for x in got], [sorted(x[1]) for x in got]
            else:
                spans, items = ([x or [] for x in column(batch, k)] for k in ("spans", "items"))
            n, hit = [len(w) for w in ws], [sum(b - a for a, b in s) for s in spans]
            yield {"id": column(batch, "id"), "n_words": n, "n_hit": hit, "n_items": [len(x) for x in items], "items": items, "spans": [[list(s) for s in x] for x in spans], "contaminated": [h > 0 and h >= share * k - 1e-9 for h, k in zip(hit, n)]}

    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items array<string>, spans array<array<long>>, contaminated boolean").withColumnRenamed("id", id)


def clean(text: bytes, spans: list, longest: int, coverage: float) -> bytes | None:
    """text without its hit spans of `longest` words or more; None where hits cover more than `coverage` of its words."""
    if not spans:
        return text
    flat = text.translate(NORMAL)
    ws = flat.split()
    if sum(b - a for a, b in spans) > coverage * len(ws):
        return None
    spans = [s for s in spans if s[1] - s[0] >= longest]
    kept, at, pos = [], 0, 0
    starts: list[tuple[int, int]] = []
    for w in ws:
        pos = flat.index(w, pos)
        starts.append((pos, pos + len(w)))
        pos += len(w)
    for a, b in spans:
        kept.append(text[at : starts[a][0]])
        at = starts[b - 1][1]
    kept.append(text[at:])
    return b"".join(kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, window: int = 13, longest: int = 1, coverage: float = 0.5, block_words: int = BLOCK) -> DataFrame:
    """docs without what occurs in the benchmark: hit spans of at least `longest` words are cut out of the text, and a document of which
    more than `coverage` is hit goes. All columns stay, and a text without hits stays as it is."""
    first, more = _blocks(benchmark, window, block_words)
    if more is None:
        said = docs.sparkSession.sparkContext.broadcast(first)
        return docs.mapInArrow(_cutter(text, longest, coverage, lambda batch, ts: [said.value.scan(words(t))[0] for t in ts]), docs.schema)
    names = [f"c{i}" for i in range(len(docs.columns))]  # other columns may have any name
    keyed = materialize(docs.toDF(*names).withColumn("hit_row", F.monotonically_increasing_id()), "rows")
    own = names[docs.columns.index(text)]
    spans = _hits(keyed.select("hit_row", F.col(own).alias("text")), more).select("hit_row", "spans")
    rows = keyed.join(spans, "hit_row", "left").select(*names, "spans")
    out = rows.mapInArrow(_cutter(own, longest, coverage, lambda batch, ts: [x or [] for x in column(batch, "spans")]), rows.schema)
    return out.drop("spans").toDF(*docs.columns)


def _cutter(text: str, longest: int, coverage: float, spans_of):
    """Batches with their texts cut, without the rows that go."""

    def run(batches):
        for batch in chunked(batches, text):
            i = batch.schema.get_field_index(text)
            gone, ts = batch.column(i).is_null().to_pylist(), texts(batch, text)
            new = [None if null else clean(t, s, longest, coverage) for null, t, s in zip(gone, ts, spans_of(batch, ts))]
            keep = pa.array([null or t is not None for null, t in zip(gone, new)], pa.bool_())
            kind = batch.schema.field(i).type
            out = batch.set_column(i, batch.schema.field(i), pa.array([t if t is None else t.decode("utf-8", "replace") for t in new], kind))
            yield out.filter(keep)

    return run


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
