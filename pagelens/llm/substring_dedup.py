"""Substring deduplication by level-wise doubling.

A window of `size` words can repeat only where the windows of a quarter and of half its length inside it repeat. Level by level, windows
that repeat at one length alone are extended to twice that length: at each of the shorter lengths one window, the one with the
least hash, stands for a window of full size (equal windows choose equal ones), so that a level moves a small part of the positions.
What repeats at a level goes into a filter of bounded size; its false positives live only until the last level, which compares
full windows by 128 bits and decides. A window whose words start earlier (smaller document, or same document and earlier start) is
covered, and so are its words.

Where copies are many, each task sends one place for a window, its earliest, and marks its others on the spot: a window that a third
of all documents share costs as many rows as there are batches, not documents. A document that repeats another's words as a whole
is known by a fingerprint: within a batch only the first of them is cut into windows at all.

Defined cases: a null or empty text has no words, and fewer words than `size` lose none; equal rows with one id count as one
document, of which no row covers the other at the same place; rows without an id are left out; an empty table gives no rows; other
columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, buckets_for, chunked, column, deal, forget, grouped, mapped, materialize, mix, release, texts, window_hashes, word_hashes
from .url_filter import Bloom

TOP = U(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, k: int, f, fill) -> np.ndarray:
    """f over x[i : i+k] for every i; beyond the end x counts as fill."""
    out = np.concatenate([x, np.full(k, fill, x.dtype)])
    n, have = len(x), 1
    while have * 2 <= k:
        out = f(out[:-have], out[have:])
        have *= 2
    if have < k:
        out = f(out[: len(out) - (k - have)], out[k - have :])
    return out[:n]


class _Words:
    """Hashes of the words of a batch's documents, with `size` blanks after each, and of their windows of doubling lengths."""

    def __init__(self, batch: pa.RecordBatch, size: int, once: bool = True):
        self.size = size
        ids = np.asarray(batch.column(batch.schema.get_field_index("id")), np.int64)
        ws = [t.split() for t in texts(batch)]  # bytes: split() knows ASCII blanks alone
        fp = [xxhash.xxh3_128_intdigest(b" ".join(w)) for w in ws]
        self.meta = (ids, np.array([len(w) for w in ws], np.int64), np.array([((x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)) for x in fp], np.int64).reshape(-1, 2))
        self.repeated: list[int] = []  # documents that another of this batch stands for
        if once:
            first: dict[int, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                if fp[i] in first and ids[i] > ids[first[fp[i]]]:
                    ws[i] = []
                else:
                    first.setdefault(fp[i], i)
        long = [i for i, w in enumerate(ws) if len(w) >= size]
        self.ids = ids[long]
        n = np.array([len(ws[i]) for i in long], np.int64)
        self.start = np.concatenate([[0], np.cumsum(n + size)])[:-1]
        total = int((n + size).sum())
        h = np.zeros(total, U)
        flat = word_hashes([w for i in long for w in ws[i]])
        self.doc = np.repeat(np.arange(len(long)), n + size)
        place = np.arange(total) - self.start[self.doc] if total else np.zeros(0, np.int64)
        inside = place < n[self.doc] if total else np.zeros(0, bool)
        h[inside] = flat
        self.place, left = place, (n[self.doc] - place if total else np.zeros(0, np.int64))
        self.full = left >= size
        self.quarter = size // 4
        w = np.full(total, TOP)
        if total:
            q = window_hashes(h, self.quarter)
            w[: len(q)] = q
            w[left < self.quarter] = TOP
        self.at = {self.quarter: w}

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from every position, from the halves."""
        if k not in self.at:
            half = self.windows(k // 2)
            out = np.full(len(half), TOP)
            out[: len(half) - k // 2] = mix(half[: len(half) - k // 2] * U(0x9E3779B97F4A7C15) + half[k // 2 :])
            self.at[k] = out
        return self.at[k]

    def stand_in(self, k: int) -> np.ndarray:
        """The least hash of the k-word windows in each full window."""
        return _sliding(self.windows(k), self.size - k + 1, np.minimum, TOP)

    def survivors(self, k: int, blooms: list[tuple[int, Bloom]]) -> tuple[np.ndarray, np.ndarray]:
        """The mask of full windows that passed all levels before k, and the places where a k-word window stands for one of them."""
        ok = self.full.copy()
        for length, bloom in blooms:
            keys, back = np.unique(self.stand_in(length)[ok], return_inverse=True)
            ok[ok] = bloom.has_hashes(keys)[back]
        if k >= self.size:
            return ok, np.flatnonzero(ok)
        least = np.where(ok, self.stand_in(k), U(0))
        most = _sliding(least[::-1], self.size - k + 1, np.maximum, U(0))[::-1]
        return ok, np.flatnonzero((most == self.windows(k)) & (most > 0))


def _dealt(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return ((i, order[cuts[i] : cuts[i + 1]]) for i in range(buckets) if cuts[i] < cuts[i + 1])


def _repeats(docs: DataFrame, size: int, k: int, blooms: list, buckets: int) -> DataFrame:
    """(key) of the k-word stand-ins that occur at two places or more."""

    def rows_of(batch):
        w = _Words(batch, size)
        _, at = w.survivors(k, [(n, b.value) for n, b in blooms])
        keys, n = np.unique(w.windows(k)[at], return_counts=True)
        out = {"bucket": [], "keys": [], "often": []}
        for i, own in _dealt((keys % U(buckets)).astype(np.int64), buckets):
            for name, v in zip(out, (i, keys[own].tobytes(), (n[own] > 1).tobytes())):
                out[name].append(v)
        return out

    def repeated(group):
        key = np.concatenate([np.frombuffer(x, U) for b in group for x in column(b, "keys")])
        often = np.concatenate([np.frombuffer(x, bool) for b in group for x in column(b, "often")])
        order = np.argsort(key)
        key, often = key[order], often[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        hit = (n > 1) | np.logical_or.reduceat(often, first)
        return {"key": key[first[hit]].view(np.int64)}

    def emit(batches):
        yield from map(rows_of, chunked(batches, limit=1_500_000))

    def count(batches):
        yield from (repeated(group) for _, group in grouped(batches))

    rows = deal(mapped(docs, emit, "bucket int, keys binary, often binary"), buckets)
    return mapped(rows, count, "key long")


def _covered(docs: DataFrame, size: int, blooms: list, buckets: int) -> DataFrame:
    """Rows (id, n, fp1, fp2) of documents, and rows (id, starts) of windows with an earlier equal one; starts are little-endian int32."""
    half = size // 2

    def by_document(ids, starts):
        """Starts packed for the documents' own buckets; ids ascending."""
        out = {k: [] for k in ("part", "who", "starts")}
        for i, own in _dealt((mix(ids.view(U)) % U(buckets)).astype(np.int64), buckets):
            who, count = np.unique(ids[own], return_counts=True)
            for name, v in zip(out, (i, who.tobytes() + count.tobytes(), starts[own].astype("<i4").tobytes())):
                out[name].append(v)
        none = [None] * len(out["part"])
        return out | {k: none for k in ("id", "n", "fp1", "fp2")}

    def rows_of(batch):
        w = _Words(batch, size)
        ids, n, fp = w.meta
        out = {"kind": [0], "bucket": [int(ids[0]) % buckets], "a": [ids.tobytes()], "b": [n.tobytes()], "c": [fp.tobytes()], "d": [b""]}
        _, at = w.survivors(size, [(k, b.value) for k, b in blooms])
        a, b, doc, place = w.windows(half)[at], w.windows(half)[np.minimum(at + half, len(w.full) - 1)] if len(at) else w.windows(half)[at], w.ids[w.doc[at]], w.place[at]
        order = np.lexsort((place, doc, b, a))
        a, b, doc, place = a[order], b[order], doc[order], place[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        later = np.flatnonzero(~first)
        if len(later):
            lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))[later]
            later = later[(doc[later] != doc[lead]) | (place[later] != place[lead])]
            later = later[np.lexsort((place[later], doc[later]))]
            for name, v in zip(out, (1, int(doc[later[0]]) % buckets if len(later) else 0, doc[later].tobytes(), place[later].astype("<i4").tobytes(), b"", b"")):
                out[name].append(v)
        keep = np.flatnonzero(first)
        for i, own in _dealt((mix(a[keep] ^ b[keep]) % U(buckets)).astype(np.int64), buckets):
            own = keep[own]
            own = own[np.argsort(doc[own], kind="stable")]
            who, count = np.unique(doc[own], return_counts=True)
            for name, v in zip(out, (2, i, who.tobytes() + count.tobytes(), place[own].astype("<i4").tobytes(), a[own].tobytes(), b[own].tobytes())):
                out[name].append(v)
        return out

    def emit(batches):
        yield from map(rows_of, chunked(batches, limit=1_500_000))

    def earlier(held):
        doc, place, a, b = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((place, doc, b, a))
        doc, place, a, b = doc[order], place[order], a[order], b[order]
        later = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(a))))
        later = np.flatnonzero(later & ((doc != doc[lead]) | (place != place[lead])))
        later = later[np.lexsort((place[later], doc[later]))]
        return by_document(doc[later], place[later])

    def decide(batches):
        for _, group in grouped(batches):
            held = []
            for kind, a, b, c, d in (x for batch in group for x in zip(*(column(batch, n) for n in ("kind", "a", "b", "c", "d")))):
                if kind == 0:
                    fp = np.frombuffer(c, np.int64).reshape(-1, 2)
                    ids = np.frombuffer(a, np.int64)
                    none = [None] * len(ids)
                    yield {"id": ids, "n": np.frombuffer(b, np.int64), "fp1": fp[:, 0], "fp2": fp[:, 1], "part": none, "who": none, "starts": none}
                elif kind == 1:
                    yield by_document(np.frombuffer(a, np.int64), np.frombuffer(b, "<i4"))
                else:
                    who, count = np.frombuffer(a, np.int64).reshape(2, -1)
                    held.append((np.repeat(who, count), np.frombuffer(b, "<i4"), np.frombuffer(c, U), np.frombuffer(d, U)))
            if held:
                yield earlier(held)

    rows = deal(mapped(docs, emit, "kind int, bucket int, a binary, b binary, c binary, d binary"), buckets)
    return mapped(rows, decide, "id long, n long, fp1 long, fp2 long, part int, who binary, starts binary")


def _by_document(found: DataFrame, buckets: int) -> DataFrame:
    """(id, starts) with all starts of a document together."""

    def together(group):
        ids, starts = [], []
        for batch in group:
            for who, s in zip(column(batch, "who"), column(batch, "starts")):
                who, count = np.frombuffer(who, np.int64).reshape(2, -1)
                ids.append(np.repeat(who, count))
                starts.append(np.frombuffer(s, "<i4"))
        ids, starts = np.concatenate(ids), np.concatenate(starts)
        order = np.argsort(ids, kind="stable")
        ids, starts = ids[order], starts[order]
        cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return {"id": ids[cut], "starts": [starts[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(ids)))]}

    def gather(batches):
        yield from (together(group) for _, group in grouped(batches, "part"))

    rows = deal(found.filter("part is not null").select("part", "who", "starts"), buckets, "part")
    return mapped(rows, gather, "id long, starts binary")


def covered_words(n: int, starts: bytes, size: int) -> np.ndarray:
    """The mask of words that the windows at starts cover."""
    edge = np.zeros(n + 1, np.int64)
    s = np.unique(np.frombuffer(starts, "<i4"))
    np.add.at(edge, s, 1)
    np.add.at(edge, s + size, -1)
    return np.cumsum(edge[:-1]) > 0


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", *, size: int = 20, keep_text: bool = False, bucket_bytes: int = 64_000_000) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document; with keep_text also `kept`, the words that stay joined by blanks.

    size: words of a window, a multiple of 4. bucket_bytes: of all texts, for which there is one bucket of windows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    buckets = buckets_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, bucket_bytes)
    blooms: list = []
    k = size // 4
    while k < size:
        keys = materialize(_repeats(rows, size, k, blooms, buckets), f"repeats{k}")
        blooms.append((k, spark.sparkContext.broadcast(Bloom.build(keys))))  # of bounded size
        forget(keys)
        k *= 2
    found = materialize(_covered(rows, size, blooms, buckets), "covered")
    for _, bloom in blooms:  # no later plan reads them
        bloom.destroy()
    release(spark)
    meta = found.filter("n is not null").select("id", "n", "fp1", "fp2")
    copies = materialize(meta.filter(f"n >= {size}").groupBy("fp1", "fp2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("fp1", "fp2", "first"), "copies")
    whole = meta.join(copies, ["fp1", "fp2"]).filter("id > first").select("id").distinct()
    some = _by_document(found, buckets)
    cut = materialize(some.join(whole.withColumn("gone", F.lit(True)), "id", "full").select("id", F.when(F.col("gone").isNull(), F.col("starts")).alias("starts"), F.coalesce("gone", F.lit(False)).alias("gone")), "cut")
    forget(found)
    said = spark.sparkContext.broadcast(Bloom.build(cut.select(F.col("id").cast("string").alias("key"))))

    def touched(batches, yes: bool):
        for batch in batches:
            if batch.num_rows:
                hit = said.value.has([str(i).encode() for i in column(batch, "id")])
                yield batch.filter(pa.array(hit == yes, pa.bool_()))

    def result(batch):
        out = {k: [] for k in ("id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else []))}
        names = set(batch.schema.names)
        starts = column(batch, "starts") if "starts" in names else [None] * batch.num_rows
        gone = column(batch, "gone") if "gone" in names else [False] * batch.num_rows
        for k, t, s, g in zip(column(batch, "id"), texts(batch), starts, gone):
            ws = t.split()
            kept = [] if g else ws
            if s and not g:
                mask = covered_words(len(ws), s, size)
                kept = [w for w, m in zip(ws, mask.tolist()) if not m]
            joined = b" ".join(kept)
            for name, v in zip(out, (k, len(ws), len(ws) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "replace"))):
                out[name].append(v)
        return out

    def finish(batches):
        yield from map(result, chunked(batches))

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")
    # Each task in Python has one worker: what is not touched ends in the task that reads it, and the join always stands between the other two.
    clean = mapped(rows, lambda batches: finish(touched(batches, False)), schema)
    other = mapped(rows.mapInArrow(lambda batches: touched(batches, True), rows.schema).join(cut.hint("merge"), "id", "left"), finish, schema)
    return clean.union(other).withColumnRenamed("id", id)


def op8(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
