"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is its bytes, ASCII letters lower-cased, and a last line feed; after each line feed comes whether the text ends there. Every
byte is predicted from the up to `order` bytes before it, across blanks and line ends: the trie of contexts holds the counts of the
bytes seen after each, and contexts are tried from the longest to the shortest. A byte that a context has not seen costs its escape and
is looked for in the next shorter one, where the bytes seen before are excluded; the last resort is uniform. A context seen T times
with q different bytes gives a byte seen c times (2c-1)/2T and the escape q/2T.

score() is pretrained: all texts that are not held out are learned from first. A context with its byte is a window, and one that many
texts share need not be coded for each of them: batches send their distinct windows to buckets by the three bytes before the byte, where
training counts meet and code lengths are found, and get them back, rounded to 2**-24. The trie thus grows with the corpus and is spread over all
tasks; only its orders 0 to 2, at most 2**24 entries, are sent to every task. adaptive() learns each document's own trie as it codes it.

Defined cases: a null or empty text is its end alone; texts of any length are coded whole; a null id is learned from and not held out;
rows that repeat an id are scored one by one; without training rows every byte is uniform, and the base score is that of an empty count;
an empty table gives no rows; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, buckets_for, chunked, column, deal, forget, grouped, mapped, materialize, mix, release, texts

END = 10  # ends a line
STEPS = 1 << 24  # code lengths travel in steps of this part of a decimal digit
LOW = 3  # orders 0 to LOW - 1 are sent to every task; windows are dealt by this many bytes of context


class Trie:
    """PPM of one process: pretrained by learn(), or adaptive, where every byte is learned after it is scored."""

    def __init__(self, order: int = 6):
        self.order, self.seen = order, {}

    def _contexts(self, past: bytes):
        past = (b"\0" * self.order + past)[-self.order :] if self.order else b""
        return [past[self.order - j :] for j in range(self.order, -1, -1)]

    def learn(self, past: bytes, symbol: int, times: int = 1) -> None:
        for ctx in self._contexts(past):
            at = self.seen.setdefault(ctx, {})
            at[symbol] = at.get(symbol, 0) + times

    def log10(self, past: bytes, symbol: int) -> float:
        out, excluded = 0.0, set()
        for ctx in self._contexts(past):
            at = {s: n for s, n in self.seen.get(ctx, {}).items() if s not in excluded}
            if not at:
                continue
            total = sum(at.values())
            if symbol in at:
                return out + math.log10((2 * at[symbol] - 1) / (2 * total))
            out += math.log10(len(at) / (2 * total))
            excluded |= at.keys()
        return out - math.log10(256 - len(excluded))

    def score(self, text: bytes, adaptive: bool = False) -> float:
        """log10 probability of a text's bytes."""
        total, s = 0.0, stream(text)
        for k in range(len(s)):
            past = s[max(0, k - self.order) : k]
            total += self.log10(past, s[k])
            if adaptive:
                self.learn(past, s[k])
        return total


def _low(g: np.ndarray, order: int) -> np.ndarray:
    """Windows cut to the last `order` bytes of context."""
    return g & U((1 << 8 * (order + 1)) - 1)


class _Level:
    """One order of the trie: entries (context and byte) and contexts, sorted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        ctx = keys >> U(8)
        self.ctx, start = np.unique(ctx, return_index=True)
        self.of = np.repeat(np.arange(len(self.ctx)), np.diff(np.append(start, len(keys))))
        self.total = np.bincount(self.of, counts, len(self.ctx))
        self.kinds = np.bincount(self.of, minlength=len(self.ctx)).astype(np.float64)
        self.below = np.zeros(len(self.ctx))  # what the next shorter context counts for the bytes seen here

    @staticmethod
    def find(where: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(where):
            return np.zeros(len(what), np.int64), np.zeros(len(what), bool)
        at = np.minimum(np.searchsorted(where, what), len(where) - 1)
        return at, where[at] == what


def code_lengths(g: np.ndarray, known: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> np.ndarray:
    """log10 probability of each window of g, by the training windows `known`, of which all that share LOW bytes of context with g are
    there; low: entries of order LOW - 1 of the whole corpus."""
    levels: list[_Level] = []
    for j in range(order + 1):
        k, c = _summed([(_low(low[0], j), low[1]) if j < LOW else (_low(known, j), counts)])
        level = _Level(k, c)
        if levels:
            at, hit = _Level.find(levels[-1].keys, _low(k, j - 1))
            level.below = np.bincount(level.of, np.where(hit, levels[-1].counts[at] if len(levels[-1].keys) else 0, 0), len(level.ctx))
        levels.append(level)
    out = np.zeros(len(g))
    open_ = np.ones(len(g), bool)
    gone_mass, gone_kinds = np.zeros(len(g)), np.zeros(len(g))
    for level, j in zip(reversed(levels), range(order, -1, -1)):
        key = _low(g, j)
        c_at, c_hit = _Level.find(level.ctx, key >> U(8))
        e_at, e_hit = _Level.find(level.keys, key)
        if not len(level.ctx):
            continue
        total, kinds = level.total[c_at] - gone_mass, level.kinds[c_at] - gone_kinds
        live = open_ & c_hit & (kinds > 0.5)
        won = live & e_hit
        out[won] += np.log10((2 * level.counts[e_at[won]] - 1) / (2 * total[won]))
        lost = live & ~e_hit
        out[lost] += np.log10(kinds[lost] / (2 * total[lost]))
        open_ &= ~won
        gone_mass = np.where(c_hit, level.below[c_at], 0.0)
        gone_kinds = np.where(c_hit, level.kinds[c_at], 0.0)
    out[open_] -= np.log10(256 - gone_kinds[open_])
    return out


class _Vocabulary(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def stream(text: bytes) -> bytes:
    """The bytes of a text that are coded: lower-cased, every blank and line feed as it stands, and a last line's end."""
    return text.lower() + bytes([END])


def stream_windows(streams: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (`order` bytes of context, zeros before the stream's start, and a byte) of all bytes of streams, and each stream's number of windows."""
    n = np.fromiter(map(len, streams), np.int64, len(streams))
    pad = b"\0" * order
    flat = b"".join([*(x for s in streams for x in (pad, s)), b"\0" * 8])
    g = np.ndarray(max(0, len(flat) - 8 - order), ">u8", flat, strides=1).astype(U) >> U(8 * (7 - order))
    sizes = np.full(2 * len(n), order, np.int64)
    sizes[::2] = n
    keep = np.repeat(np.arange(len(sizes)) % 2 == 0, sizes)[: len(g)]
    return g[keep], n


def _summed(sums: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all tables, each with the sum of its counts."""
    keys, counts = (np.concatenate(x) for x in zip(*sums))
    if not len(keys):
        return keys, counts
    at = np.argsort(keys)
    keys = keys[at]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[at], first)


def _runs(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs, by one sort (np.unique hashes first, which is slower here)."""
    g = np.sort(g)
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    return g[first], np.diff(np.append(first, len(g)))


def _zip(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True)


def _unzip(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)


def _pack(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, compressed: sorted ones shrink to a byte or two."""
    return _zip(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(b: bytes, kind=U) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(8, -1).T).view(kind).ravel()


def score(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text", *, order: int = 6, batch_bytes: int = 32_000_000, bucket_bytes: int = 256_000_000) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; the model learns from rows that are not held out.

    order: bytes of context, 3 to 7. batch_bytes: of text whose windows and tokens are sent together. bucket_bytes: of all texts, for
    which there is one bucket of windows. Tokens, for the unigram base, travel as windows do.
    """
    spark = docs.sparkSession
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), held_out.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(spark, size, bucket_bytes)
    names = ("kind", "batch", "bucket", "ids", "held", "a", "b")
    schema = f"kind string, batch long, bucket int, ids array<{kind}>, held array<boolean>, a binary, b binary"

    def dealt(of):
        at = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[at], np.arange(buckets + 1))
        return ((i, at[cuts[i] : cuts[i + 1]]) for i in range(buckets) if cuts[i] < cuts[i + 1])

    def read(batches):
        """Rows of one batch after the other; texts leave as soon as a portion of them is counted."""
        no, sums, count, size = TaskContext.get().partitionId() << 24, [], {}, 0

        def portion(part):
            nonlocal sums
            streams, held = [x[2] for x in part], [x[1] for x in part]
            for s, h in zip(streams, held):
                for w in s.split():
                    count[w] = count.get(w, 0) + (not h)
            g, n = stream_windows(streams, order)
            keys, _ = _runs(g)
            taught, times = _runs(g[np.repeat(np.logical_not(held), n)])
            c = np.zeros(len(keys), np.int64)
            c[np.searchsorted(keys, taught)] = times
            sums.append((keys, c))
            if len(sums) >= 8:
                sums = [_summed(sums)]
            yield "D", no, -1, [x[0] for x in part], held, _zip(b"".join(streams)), _pack(np.array([len(x) for x in streams], np.int64))

        def tokens():
            ws = list(count)
            n = np.fromiter(count.values(), np.int64, len(count))
            for i, own in dealt((np.fromiter(map(xxhash.xxh3_64_intdigest, ws), U, len(ws)) % U(buckets)).astype(np.int64)):
                yield "T", no, i, None, None, _zip(b" ".join([ws[j] for j in own.tolist()])), _pack(n[own])

        def windows():
            keys, n = _summed(sums)
            taught = n > 0
            few, c = _summed([(_low(keys[taught], LOW - 1), n[taught])])
            yield "L", no, -1, None, None, _pack(few), _pack(c)
            for i, own in dealt((mix((keys >> U(8)) & U((1 << 8 * LOW) - 1)) % U(buckets)).astype(np.int64)):
                yield "W", no, i, None, None, _pack(keys[own]), _pack(n[own])

        def out(rows):
            held, size = [], 0
            for r in rows:
                held.append(r)
                size += len(r[5])
                if size > 1_000_000 or len(held) == 2000:
                    yield dict(zip(names, map(list, zip(*held))))
                    held, size = [], 0
            if held:
                yield dict(zip(names, map(list, zip(*held))))

        for batch in chunked(batches, limit=1_000_000):
            part = [(k, bool(held), stream(t)) for k, t, held in zip(column(batch, "id"), texts(batch), column(batch, "held"))]
            yield from out(portion(part))
            size += sum(len(x[2]) for x in part)
            if len(count) > 250_000:
                yield from out(tokens())
                count = {}
            if size >= batch_bytes:
                yield from out(tokens())
                yield from out(windows())
                no, sums, count, size = no + 1, [], {}, 0
        if size:
            yield from out(tokens())
            yield from out(windows())

    table = materialize(mapped(rows, read, schema), "streams", by="kind")
    asked = deal(table.filter("kind = 'T'").select("bucket", "batch", "a", "b"), buckets, "bucket", "batch")

    def merge(batches):
        for bucket, group in grouped(batches):
            vocabulary, count, places = _Vocabulary(), [], []
            for batch in group:
                for no, a, b in zip(*(column(batch, x) for x in ("batch", "a", "b"))):
                    ws = _unzip(a).split(b" ")
                    places.append((no, a, np.fromiter(map(vocabulary.__getitem__, ws), np.int32, len(ws))))
                    count.append(_unpack(b, np.int64))
            total = np.bincount(np.concatenate([x[2] for x in places]), np.concatenate(count), len(vocabulary)).astype(np.int64)
            for i, (no, a, at) in enumerate(places):
                yield {"batch": [no], "a": [a], "b": [_pack(total[at])], "tokens": [0 if i else int(total.sum())], "kinds": [0 if i else int((total > 0).sum())]}

    words = materialize(mapped(asked, merge, "batch long, a binary, b binary, tokens long, kinds long"), "words")
    forget(table, "kind=T")

    def ends_of(batches):
        for batch in batches:
            for held, a, b in zip(*(column(batch, x) for x in ("held", "a", "b"))):
                data, at = _unzip(a), 0
                for h, n in zip(held, _unpack(b, np.int64).tolist()):
                    if not h:
                        yield {"texts": [1], "lines": [data.count(b"\n", at, at + n)]}
                    at += n

    documents = table.filter("kind = 'D'").select("batch", "ids", "held", "a", "b")
    ends, all_lines = mapped(documents, ends_of, "texts long, lines long").agg(F.coalesce(F.sum("texts"), F.lit(0)), F.coalesce(F.sum("lines"), F.lit(0))).first()
    told = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n_train, v_train = told[0] + ends, told[1] + (ends > 0)

    def lows(batches):
        sums = [(np.zeros(0, U), np.zeros(0, np.int64))]
        for batch in batches:
            for k, c in zip(column(batch, "a"), column(batch, "b")):
                sums = [_summed([*sums, (_unpack(k), _unpack(c, np.int64))])]
        yield {"a": [_pack(sums[0][0])], "b": [_pack(sums[0][1])]}

    low = mapped(mapped(table.filter("kind = 'L'").select("a", "b"), lows, "a binary, b binary").coalesce(1), lows, "a binary, b binary").first()
    said = spark.sparkContext.broadcast((_unpack(low.a), _unpack(low.b, np.int64).astype(np.float64)) if low else (np.zeros(0, U), np.zeros(0)))
    release(spark)

    def price(batches):
        for _, group in grouped(batches):
            sums, held = [], 0
            for batch in group:
                for a, b in zip(column(batch, "a"), column(batch, "b")):
                    sums.append((_unpack(a), _unpack(b, np.int64)))
                    held += len(sums[-1][0])
                    if held > 4_000_000:
                        sums = [_summed(sums)]
                        held = 0
            all_keys, count = _summed(sums)
            known = count > 0
            k, c = all_keys[known], count[known].astype(np.float64)
            cost = np.rint(code_lengths(all_keys, k, c, said.value, order) * -STEPS).astype("<u4")
            for batch in group:
                for no, a in zip(column(batch, "batch"), column(batch, "a")):
                    own = cost[np.searchsorted(all_keys, _unpack(a))]
                    yield {"kind": ["B"], "batch": [no], "ids": [None], "held": [None], "a": [a], "b": [_zip(own.view(np.uint8).reshape(-1, 4).T.tobytes())]}

    final = f"kind string, batch long, ids array<{kind}>, held array<boolean>, a binary, b binary"
    priced = mapped(deal(table.filter("kind = 'W'").select("bucket", "batch", "a", "b"), buckets, "bucket", "batch"), price, final)
    none = [F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held")]
    counted = words.select(F.lit("A").alias("kind"), "batch", *none, "a", "b")
    coded = documents.select(F.lit("D").alias("kind"), "batch", "ids", "held", "a", "b")
    floor = n_train + 0.5 * (v_train + 1)
    end_base = math.log10((ends + 0.5) / floor)
    stop = (ends + 0.5) / (all_lines + 1)

    def total(batches):
        for _, group in grouped(batches, "batch"):
            count, keys, prices, ready = {}, [np.zeros(0, U)], [np.zeros(0, "<u4")], False
            for batch in group:  # answers sort before documents
                for what, ids, held, a, b in zip(*(column(batch, x) for x in ("kind", "ids", "held", "a", "b"))):
                    if what == "A":
                        count.update(zip(_unzip(a).split(b" "), _unpack(b, np.int64).tolist()))
                        continue
                    if what == "B":
                        keys.append(_unpack(a))
                        prices.append(np.ascontiguousarray(np.frombuffer(_unzip(b), np.uint8).reshape(4, -1).T).view("<u4").ravel())
                        continue
                    if not ready:
                        keys, prices, ready = np.concatenate(keys), np.concatenate(prices), True
                        at = np.argsort(keys)
                        keys, prices = keys[at], prices[at]
                    data, edges = _unzip(a), np.concatenate([[0], np.cumsum(_unpack(b, np.int64))]).tolist()
                    streams = [data[x:y] for x, y in zip(edges, edges[1:])]
                    out = {k: [] for k in ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
                    g, size = stream_windows(streams, order)
                    at = np.argsort(g)
                    cost = np.empty(len(g), np.int64)
                    cost[at] = prices[np.searchsorted(keys, g[at])]
                    sums = np.add.reduceat(cost, np.cumsum(size) - size) / -STEPS
                    for k, h, s, sum_ in zip(ids, held, streams, sums.tolist()):
                        c = np.fromiter(map(count.__getitem__, ws := s.split()), np.int64, len(ws))
                        base = float(np.log10((c + 0.5) / floor).sum()) + end_base
                        score_ = sum_ + math.log10(stop) + (s.count(b"\n") - 1) * math.log10(1 - stop)
                        for name, x in zip(out, (k, h, len(ws) + 1, int((c > 0).sum()) + (ends > 0), n_train, base, score_)):
                            out[name].append(x)
                    yield out

    parts = counted.union(priced).union(coded).repartition(buckets_for(spark, size, batch_bytes // 2, 1 << 20), "batch").sortWithinPartitions("batch", "kind")
    out = mapped(parts, total, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id)


def adaptive(docs: DataFrame, id: str = "doc_id", text: str = "text", *, order: int = 6) -> DataFrame:
    """(id, score) with a trie of each document's own, learned byte by byte as it is scored."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        for batch in chunked(batches):
            yield {"id": column(batch, "id"), "score": [Trie(order).score(t, adaptive=True) for t in texts(batch)]}

    return mapped(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), run, f"id {kind}, score double").withColumnRenamed("id", id)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False)))
