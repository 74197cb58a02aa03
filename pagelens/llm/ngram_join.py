"""N-gram Jaccard join in the metric space of shingle sets, whose distance is 1 - |A and B| / |A or B|.

Shingle sets lie at distance 1 from nearly all document pivots, where the additive window holds everything; so the first level's
pivots are single shingles (of two sets that are within the radius, one lacks at most a quarter of the other's shingles, so the first
quarter and one more of a set, in any one order, is its window over these pivots), and document pivots with Voronoi regions split
what is left of the cells:

1. Every text is hashed to its set. A window of two fifths goes by shingle, in packed blocks, to be counted; a document of which too
   few of them occur elsewhere has no partner, by the same inequality, and is done. Equal sets are one class from here on.
2. Among the sets that remain, shingles are counted again, whole; a set of which a quarter stands alone is done too. The others are
   cut into cells, one for each shingle of their windows, rarest first; cells of equal members are one.
3. Each class is compared with the pivot of its first cell; links join components. A cell within one component is done.
4. A cell of up to `small` sets is one task's work: pivots, farthest first, divide it into Voronoi regions. A pivot's region takes the
   sets nearest to it and, by the triangle inequality, those that are no more than twice the radius farther from it than from their
   own pivot, nor farther from it than its own sets and the radius reach; sets far from all pivots are a region too. Regions are cells
   again, until a handful of sets is left or all are one component; every link is a pivot's. Where the windows of all regions together
   would be as much work as the cell is, it goes on undivided without its pivots, so that a cell never costs more than all its pairs.
5. A larger cell is divided the same way by two pivots, distributedly, as long as that lessens the work; what no longer divides is
   compared in pairs of blocks, each by step 4.

Only spanning links are kept, so that a group of copies costs as many rows as it has members. Nothing is gathered in one place.
Whole sets are shuffled only where they are counted or compared: filters of bounded size pick them, and what these let through besides
is dropped by the next count or join. Tables that no later step reads are removed.

Defined cases: no words or no text gives an empty set, linked with nothing; fewer than k words are one shingle; equal sets link;
rows that repeat an id count as the one with the smallest fingerprint; rows without an id are left out; texts of any length are
hashed whole; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U, buckets_for, chunked, column, components, deal, forget, grouped, labels, mapped, materialize, mix, release, texts, window_hashes, word_hashes
from .url_filter import Bloom

#: Share of a set, beyond the window that one common shingle needs, in which partners must meet again and again.
EXTRA = 15


def least_common(n, tenths: int = 75):
    """Common shingles that a set of n must have with a partner, at least."""
    return -(-n * tenths // 100)


def _extra(n):
    return np.maximum(1, n * EXTRA // 100)


def shingles(ws: list[bytes], h: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of k-word shingles, ascending."""
    if not ws:
        return np.empty(0, U)
    return np.unique(window_hashes(h, k)) if len(ws) >= k else mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), 1 + len(ws))], U))


def _sets(batch, k: int):
    """Each text's set, with all words of the batch hashed at once."""
    ws = [t.lower().split() for t in texts(batch)]  # bytes: lower() and split() know A-Z and ASCII blanks alone
    h = word_hashes([w for x in ws for w in x])
    at = 0
    for x in ws:
        yield shingles(x, h[at : at + len(x)], k)
        at += len(x)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def _ids(batch) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index("id")), np.int64)


def _thin(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, each in as many bytes as the largest needs; that number of bytes comes first."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _thick(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


def _steps(ids: np.ndarray) -> bytes:
    """Ascending ids as the first one and the steps between them: ids that lie close together take a byte or two each."""
    return ids[:1].tobytes() + _thin(np.diff(ids.view(U)))


def _unsteps(x: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(x, U, 1), _thick(x[8:]).view(U)]), dtype=U).view(np.int64)


def _packed(keys: np.ndarray, own: np.ndarray, ids: np.ndarray, buckets: int, short: bool = False):
    """(bucket, ids, counts, keys): the keys of each bucket with their owners in runs; see _unsteps() and _thick().

    short: keys are cut to 32 bits beyond those that the bucket tells, so that a few of different keys look alike.
    """
    if (ids[1:] < ids[:-1]).any():
        rank = np.argsort(ids, kind="stable")
        own = np.argsort(rank)[own]
        order = np.argsort(own, kind="stable")
        keys, own, ids = keys[order], own[order], ids[rank]
    b = (keys % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    keys, own = keys[order], own[order]
    if short:
        keys = (keys // U(buckets)).astype(np.uint32)
    cuts = np.searchsorted(b[order], np.arange(buckets + 1))
    for i in range(buckets):
        if cuts[i] < cuts[i + 1]:
            who, count = np.unique(own[cuts[i] : cuts[i + 1]], return_counts=True)
            yield i, _steps(ids[who]), _thin(count), keys[cuts[i] : cuts[i + 1]].tobytes()


def _filter(ids: DataFrame) -> Bloom:
    """A filter of bounded size that holds every id of the column id; ask it by _held()."""

    def hashed(batches):
        for batch in batches:
            yield {"key": mix(_ids(batch).view(U)).view(np.int64)}

    return Bloom.build(mapped(ids.select("id"), hashed, "key long"))


def _held(bloom: Bloom, ids: np.ndarray) -> np.ndarray:
    return bloom.has_hashes(mix(ids.view(U)))


def _some(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of ids, and few others that the filter cannot tell from them: what a join by id needs, without a shuffle of all sets."""
    said = sets.sparkSession.sparkContext.broadcast(_filter(ids))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(_held(said.value, _ids(batch)), pa.bool_()))

    return sets.mapInArrow(run, sets.schema)


def _survey(docs: DataFrame, k: int, tenths: int, buckets: int) -> DataFrame:
    """Rows (id, n, fp1, fp2) of documents and (id, seen): how many shingles of a document's wide window occur in other documents' too.

    Shingles are told apart by the bucket and 32 bits more, so seen is now and then too large and never too small.
    """

    def emit(batches):
        for batch in chunked(batches):
            ids, sets = _ids(batch), list(_sets(batch, k))
            n = np.array([len(s) for s in sets], np.int64)
            fp = np.array([_fingerprint(s) for s in sets], np.int64)
            out = {"kind": [0], "bucket": [int(ids[0]) % buckets], "a": [ids.tobytes()], "b": [n.tobytes()], "c": [fp.tobytes()]}
            take = np.where(n > 0, np.minimum(n, n - least_common(n, tenths) + _extra(n)), 0)
            keys = np.concatenate([s[:t] for s, t in zip(sets, take.tolist())])
            own = np.repeat(np.arange(len(n)), take)
            for row in _packed(keys, own, ids, buckets, short=True):
                for name, v in zip(out, (1, *row)):
                    out[name].append(v)
            yield out

    def count(batches):
        for _, group in grouped(batches):
            own, counts, keys = [], [], []
            for batch in group:
                for kind, a, b, c in zip(*(column(batch, x) for x in ("kind", "a", "b", "c"))):
                    if kind == 0:
                        fp = np.frombuffer(c, np.int64).reshape(-1, 2)
                        ids = np.frombuffer(a, np.int64)
                        yield {"id": ids, "n": np.frombuffer(b, np.int64), "fp1": fp[:, 0], "fp2": fp[:, 1], "seen": np.full(len(ids), -1)}
                    else:
                        own.append(_unsteps(a))
                        counts.append(_thick(b))
                        keys.append(np.frombuffer(c, np.uint32))
            if keys:
                key = np.concatenate(keys)
                who = np.repeat(np.concatenate(own), np.concatenate(counts))
                order = np.argsort(key, kind="stable")
                key = key[order]
                same = key[1:] == key[:-1]
                mask = np.zeros(len(key), bool)
                mask[1:] |= same
                mask[:-1] |= same
                ids, seen = np.unique(who[order[mask]], return_counts=True)
                zero = np.zeros(len(ids), np.int64)
                yield {"id": ids, "n": zero, "fp1": zero, "fp2": zero, "seen": seen}

    rows = deal(mapped(docs, emit, "kind int, bucket int, a binary, b binary, c binary"), buckets)
    return mapped(rows, count, "id long, n long, fp1 long, fp2 long, seen long")


def _candidate_sets(docs: DataFrame, chosen: DataFrame, repeated: DataFrame, k: int) -> list[DataFrame]:
    """Tables (id, n, h) which hold the sets of the chosen (id, fp1, fp2), one row for an id, and few others.

    Filters of bounded size find them without a shuffle. What else the first lets through is a whole set of its own id, which the next
    step counts as any other. An id that more than one row has is left to an exact join, for these rows' texts may differ.
    """
    said = docs.sparkSession.sparkContext.broadcast((_filter(chosen), _filter(repeated)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(_held(said.value[0], _ids(batch)), pa.bool_()))
            for part in chunked([batch]):
                ids, sets = _ids(part), list(_sets(part, k))
                again = _held(said.value[1], ids)
                fp = [_fingerprint(s) if x else (0, 0) for s, x in zip(sets, again.tolist())]
                yield {"id": ids, "again": again, "fp1": [x[0] for x in fp], "fp2": [x[1] for x in fp], "n": [len(s) for s in sets], "h": [s.view(np.int64) for s in sets]}

    found = materialize(mapped(docs, run, "id long, again boolean, fp1 long, fp2 long, n long, h array<long>"), "found")
    out = [found.filter("not again").select("id", "n", "h")]
    out[0]._pagelens_path = found._pagelens_path
    rest = found.filter("again")
    if not rest.isEmpty():
        out.append(materialize(rest.join(chosen, ["id", "fp1", "fp2"], "left_semi").dropDuplicates(["id"]).select("id", "n", "h"), "again"))
    return out


def _windows(sets: DataFrame, tenths: int, buckets: int) -> DataFrame:
    """(id, n, alone, pivots): how many shingles of a set no other set has, and its window over the shingle pivots, rarest first.

    Sets of which more are alone than a partner may lack are left out; they have no link.
    """

    def emit(batches):
        for batch in batches:
            h = batch.column(1)
            values, offsets = np.asarray(h.flatten(), np.int64).view(U), np.concatenate([[0], np.cumsum(np.asarray(h.value_lengths(), np.int64))])
            ids = _ids(batch)
            for a in range(0, len(ids), 500):
                b = min(len(ids), a + 500)
                rows = list(_packed(values[offsets[a] : offsets[b]], np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1])), ids[a:b], buckets))
                yield {k: [r[i] for r in rows] for i, k in enumerate(("bucket", "a", "b", "c"))}

    def count(batches):
        for _, group in grouped(batches):
            own = np.concatenate([_unsteps(x) for b in group for x in column(b, "a")])
            runs = np.concatenate([_thick(x) for b in group for x in column(b, "b")])
            key = np.concatenate([np.frombuffer(x, U) for b in group for x in column(b, "c")])
            _, back, df = np.unique(key, return_inverse=True, return_counts=True)
            df = df[back]
            who = np.repeat(own, runs)
            shared = np.flatnonzero(df > 1)
            shared = shared[np.argsort(who[shared], kind="stable")]
            who, key, df = who[shared], key[shared], df[shared].astype(np.int32)
            out = {k: [] for k in ("part", "a", "b", "c")}
            part = (mix(who.view(U)) % U(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            for i in range(buckets):
                if cuts[i] < cuts[i + 1]:
                    x = order[cuts[i] : cuts[i + 1]]
                    for name, v in zip(out, (i, who[x].tobytes(), key[x].tobytes(), df[x].tobytes())):
                        out[name].append(v)
            yield out

    def choose(batches):
        for _, group in grouped(batches, "part"):
            who, key, df, size = [], [], [], {}
            for batch in group:
                for n, a, b, c in zip(*(column(batch, x) for x in ("n", "a", "b", "c"))):
                    if n is not None:
                        size.update(zip(np.frombuffer(a, np.int64).tolist(), np.frombuffer(b, np.int64).tolist()))
                    else:
                        who.append(np.frombuffer(a, np.int64))
                        key.append(np.frombuffer(b, U))
                        df.append(np.frombuffer(c, np.int32))
            if not who:
                continue
            who, key, df = np.concatenate(who), np.concatenate(key), np.concatenate(df)
            order = np.lexsort((key, df, who))
            who, key = who[order], key[order]
            cut = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            out = {k: [] for k in ("id", "n", "alone", "pivots")}
            for x, y in zip(cut.tolist(), np.append(cut[1:], len(who)).tolist()):
                n = size[int(who[x])]
                room = y - x - least_common(n, tenths) + 1
                if room > 0:
                    for name, v in zip(out, (int(who[x]), n, n - (y - x), key[x : x + room].view(np.int64))):
                        out[name].append(v)
            yield out

    def sizes(batches):
        for batch in batches:
            ids, n = _ids(batch), np.asarray(batch.column(1), np.int64)
            part = (mix(ids.view(U)) % U(buckets)).astype(np.int64)
            some = np.unique(part).tolist()
            yield {"part": some, "n": [1] * len(some), "a": [ids[part == i].tobytes() for i in some], "b": [n[part == i].tobytes() for i in some], "c": [b""] * len(some)}

    packed = deal(mapped(sets.select("id", "h"), emit, "bucket int, a binary, b binary, c binary"), buckets)
    schema = "part int, n int, a binary, b binary, c binary"
    found = mapped(packed, count, "part int, a binary, b binary, c binary").select("part", F.lit(None).cast("int").alias("n"), "a", "b", "c")
    both = deal(found.union(mapped(sets.select("id", "n"), sizes, schema)), buckets, "part")
    return mapped(both, choose, "id long, n long, alone long, pivots array<long>")


def _compare(pairs: DataFrame, sets: DataFrame, radius: float) -> DataFrame:
    """(a, b, far, near) of pairs: far is the distance, near whether it is within the radius. Adaptive execution splits a pivot with many partners."""
    pairs = materialize(pairs, "pairs")
    sets = _some(sets, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    x = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    y = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    either = F.col("na") + F.col("nb") - F.col("both")
    out = pairs.join(x, "a").join(y, "b").withColumn("both", both)
    return out.select("a", "b", (1 - F.col("both") / either).alias("far"), (100 * F.col("both") >= round(100 * (1 - radius)) * either).alias("near"))


def _middle(r: int):
    """Order of pivots: sets with the least of their own lie in the middle of a group of near copies and reach most of it."""
    return F.struct(F.col("alone") / F.col("n"), F.xxhash64("id", F.lit(r)))


class Regions:
    """The links between sets of different components in one group, found by recursive Voronoi regions of pivots.

    keys, at: the sets' shared shingles as small numbers, set by set, and where each set starts; n: whole sizes; comp: a number for each
    component, which links join. regions and distances count what was done.
    """

    def __init__(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray, comp: np.ndarray, percent: int, pivots: int = 8, leaf: int = 8):
        self.keys, self.at, self.n, self.comp = keys, at, n, comp.copy()
        self.percent, self.radius, self.pivots, self.leaf = percent, 1 - percent / 100, pivots, leaf
        self.mark = np.zeros(int(keys.max()) + 1 if len(keys) else 1, bool)
        self.links: list[tuple[int, int]] = []
        self.regions = self.distances = 0

    def far(self, p: int, rows: np.ndarray, keys: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Distances of rows, whose shingles are keys cut at edges, from p; rows within the radius join its component."""
        own = self.keys[self.at[p] : self.at[p + 1]]
        self.mark[own] = True
        both = np.diff(np.concatenate([[0], np.cumsum(self.mark[keys])])[edges])
        self.mark[own] = False
        either = self.n[p] + self.n[rows] - both
        self.distances += len(rows)
        for i in rows[(100 * both >= self.percent * either) & (self.comp[rows] != self.comp[p])].tolist():
            if self.comp[i] != self.comp[p]:
                self.links.append((p, i))
                self.comp[self.comp == self.comp[i]] = self.comp[p]
        return 1 - both / either

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.at[rows + 1] - self.at[rows]
        edges = np.concatenate([[0], np.cumsum(size)])
        return self.keys[np.repeat(self.at[rows] - edges[:-1], size) + np.arange(edges[-1])], edges

    def run(self) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.n))]
        while todo:
            rows = todo.pop()
            if len(rows) < 2 or (self.comp[rows] == self.comp[rows[0]]).all():
                continue
            self.regions += 1
            keys, edges = self._gather(rows)
            if len(rows) <= self.leaf:
                for i in range(len(rows) - 1):
                    self.far(int(rows[i]), rows[i + 1 :], keys[edges[i + 1] :], edges[i + 1 :] - edges[i + 1])
                continue
            chosen, away = [0], []
            while True:
                away.append(self.far(int(rows[chosen[-1]]), rows, keys, edges))
                near = np.min(away, axis=0)
                near[chosen] = -1
                if len(chosen) >= min(self.pivots, len(rows) // 2):
                    break
                chosen.append(int(near.argmax()))
            todo += self.divide(rows, chosen, np.array(away))
        return self.links

    def divide(self, rows: np.ndarray, chosen: list[int], away: np.ndarray) -> list[np.ndarray]:
        """The regions of pivots that have met all others: any two others within the radius share one."""
        r, slack = self.radius, 1e-9
        rest = np.ones(len(rows), bool)
        rest[chosen] = False
        nearest, near = away.argmin(axis=0), away.min(axis=0)
        outside = 2 * r  # a set at least so far from every pivot belongs to none
        out = []
        for p, d in enumerate(away):
            own = rest & (nearest == p) & (near < outside)
            if own.any():
                out.append(rows[rest & (d <= near + 2 * r + slack) & (d <= near[own].max() + r + slack)])
        if (rest & (near >= outside)).any():
            out.append(rows[rest & (near >= outside - r - slack)])
        if sum(len(x) ** 2 for x in out) > 0.8 * int(rest.sum()) ** 2:
            return [rows[rest]]  # windows that hold nearly all of it in every region: other pivots may divide it, and these are done
        return out


def _region_links(percent: int):
    """A spanning forest of the links between sets of different components in one group."""

    def run(group):
        import pyarrow as pa

        ids = np.asarray(group["id"].combine_chunks(), np.int64)
        _, comp = np.unique(np.asarray(group["comp"].combine_chunks(), np.int64), return_inverse=True)
        h = group["h"].combine_chunks()
        n = np.asarray(h.value_lengths(), np.int64)
        _, key, df = np.unique(np.asarray(h.flatten(), np.int64), return_inverse=True, return_counts=True)
        shared = (df > 1)[key]
        at = np.concatenate([[0], np.cumsum(shared)])[np.concatenate([[0], np.cumsum(n)])]
        links = Regions(key[shared], at, n, comp, percent).run()
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


class _Join:
    def __init__(self, sets: DataFrame, windows: DataFrame, tenths: int, small: int):
        self.sets, self.windows, self.tenths, self.radius, self.small = sets, windows, tenths, 1 - tenths / 100, small
        self.label = sets.select("id", F.col("id").alias("comp"))

    def link(self, near: DataFrame) -> None:
        """Join the components of linked pairs (a, b)."""
        at = self.label
        edges = near.select("a", "b").join(at.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(at.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        edges = materialize(edges.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return
        moved = materialize(components(edges).select(F.col("id").alias("comp"), F.col("component").alias("to")), "moved")
        self.label = materialize(at.join(moved, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "label")

    def open_cells(self, cells: DataFrame) -> DataFrame:
        """(cell, id, n, alone, comp, size) of the cells that hold more than one component."""
        rows = materialize(cells.select("cell", "id", "n", "alone").join(self.label, "id"), "cells")
        some = rows.groupBy("cell").agg(F.count("*").alias("size"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("cell", "size")
        return materialize(rows.join(some, "cell"), "open")

    def cells(self) -> DataFrame:
        window = self.windows.select("id", "n", "alone", F.explode("pivots").alias("cell"))
        window = materialize(window, "window")
        kinds = window.groupBy("cell").agg(F.count("*").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum((F.xxhash64("id", F.lit(7)) / 4096).cast("long")).alias("s")).filter("m > 1")
        one = kinds.groupBy("m", "lo", "hi", "x", "s").agg(F.min("cell").alias("cell")).select("cell")
        return materialize(window.join(materialize(one, "one"), "cell"), "cells")

    def run(self) -> DataFrame:
        cells = self.cells()
        pivot = cells.groupBy("cell").agg(F.min_by(F.struct("id", _middle(0).alias("rank")), _middle(0)).alias("p")).select("cell", "p.*").withColumnRenamed("id", "p")
        home = cells.select("cell", "id").join(pivot, "cell").filter("id <> p").groupBy("id").agg(F.min_by("p", "rank").alias("p"))
        home = home.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        self.link(materialize(_compare(home, self.sets, self.radius).filter("near"), "home"))
        before, r = None, 0
        while True:
            release(self.sets.sparkSession)
            rows = self.open_cells(cells)
            most, work = rows.agg(F.max("size"), F.sum(F.when(F.col("size") > self.small, F.col("size")))).first()  # a cell of m sets adds m times m
            if most is None:
                return self.label
            self.settle(rows.filter(F.col("size") <= self.small))
            many = rows.filter(F.col("size") > self.small)
            if most <= self.small or before is not None and work > 0.8 * before:
                self.settle(many)
                return self.label
            before, r = work, r + 1
            pivots = self.pivots(many, r)
            each = many.join(pivots, "cell").select("id", F.explode(F.array("p1", "p2")).alias("p")).filter("id <> p")
            seen = materialize(_compare(each.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct(), self.sets, self.radius), "seen")
            self.link(seen.filter("near"))
            cells = self.regions(many, pivots, seen, r)

    def settle(self, left: DataFrame, block: int = 512, shingles: int = 1_000_000) -> None:
        """Divide what is left of cells within tasks, across components, in pairs of blocks of about `block` sets and `shingles` of theirs.

        Cells that share documents form a region; it is taken as one where that means fewer comparisons than its cells do.
        """
        if left.isEmpty():
            return
        whole = components(left.select(F.col("id").alias("a"), F.col("cell").alias("b"))).select(F.col("id").alias("cell"), F.col("component").alias("region"))
        rows = materialize(left.join(whole, "cell"), "left")
        cost = rows.groupBy("region").agg(F.countDistinct("id").alias("k"), F.sum("size").alias("s"))  # a cell of m rows adds m times m
        rows = rows.join(cost, "region").withColumn("key", F.when(F.col("k") * F.col("k") <= F.col("s"), F.col("region")).otherwise(F.col("cell")))
        rows = materialize(rows.select("key", "id", "n", "comp").distinct(), "keys")
        blocks = rows.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / shingles)).cast("int").alias("blocks"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("key", "blocks")
        at = rows.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sets = _some(self.sets, rows.join(blocks, "key", "left_semi").select("id").distinct())
        at = at.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id", "comp").join(sets.select("id", "h"), "id")
        near = at.groupBy("key", "lo", "hi").applyInArrow(_region_links(self.tenths), "a long, b long")
        self.link(materialize(near, "near"))

    def pivots(self, rows: DataFrame, r: int) -> DataFrame:
        """(cell, p1, p2): two documents of different components in every cell."""
        rank = _middle(r)
        p1 = rows.groupBy("cell").agg(F.min_by(F.struct("id", "comp"), rank).alias("p1"))
        p2 = rows.join(p1, "cell").filter("comp <> p1.comp").groupBy("cell").agg(F.min_by("id", rank).alias("p2"))
        return materialize(p1.join(p2, "cell").select("cell", F.col("p1.id").alias("p1"), "p2"), "pivots")

    def regions(self, rows: DataFrame, pivots: DataFrame, seen: DataFrame, r: int) -> DataFrame:
        """Voronoi regions of two pivots in every cell, with windows of twice the radius; the pivots themselves have met all others."""
        to = seen.select(F.col("a").alias("id"), F.col("b").alias("p"), "far").union(seen.select(F.col("b").alias("id"), F.col("a").alias("p"), "far"))
        at = rows.join(pivots, "cell").filter("id <> p1 and id <> p2")
        at = at.join(to.select("id", F.col("p").alias("p1"), F.col("far").alias("d1")), ["id", "p1"]).join(to.select("id", F.col("p").alias("p2"), F.col("far").alias("d2")), ["id", "p2"])
        window = 2 * self.radius + 1e-9
        at = materialize(at.select("cell", "id", "n", "alone", (F.col("d1") <= F.col("d2") + window).alias("in1"), (F.col("d2") <= F.col("d1") + window).alias("in2")), "regions")
        second = at.filter("in2 and not in1").select("cell").distinct()  # a second region without documents of its own would hold no new pair
        left = at.filter("in1").select(F.xxhash64("cell", F.lit(2 * r)).alias("cell"), "id", "n", "alone")
        right = at.filter("in2").join(second, "cell", "left_semi").select(F.xxhash64("cell", F.lit(2 * r + 1)).alias("cell"), "id", "n", "alone")
        return materialize(left.union(right), "cells")


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 75, small: int = 512, bucket_bytes: int = 128_000_000) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    buckets = buckets_for(spark, rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, bucket_bytes)
    survey = materialize(_survey(rows, k, percent, buckets), "survey")
    release(spark)
    meta = survey.filter("seen < 0").groupBy("id").agg(F.min(F.struct("fp1", "fp2", "n")).alias("x"), F.count("*").alias("times")).select("id", "x.*", "times")
    meta = materialize(meta, "meta")
    classes = materialize(meta.filter("n > 0").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    seen = survey.filter("seen >= 0").groupBy("id").agg(F.sum("seen").alias("seen"))
    least = f"greatest(1, cast(ceil(n * {percent} / 100) as long) * {EXTRA} div 100)"
    chosen = meta.join(seen, "id").filter(f"n > 0 and seen >= {least}").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "fp1", "fp2")
    chosen = materialize(chosen, "chosen")
    forget(survey)
    found = _candidate_sets(rows, chosen, meta.filter("times > 1"), k)
    release(spark)
    sets = functools.reduce(DataFrame.union, found)
    windows = materialize(_windows(sets, percent, buckets), "windows")
    release(spark)
    sets = materialize(_some(sets, windows), "sets")
    for t in found:
        forget(t)
    label = _Join(sets, windows, percent, small).run()
    copies = classes.filter("m > 1").select("fp1", "fp2", "rep")
    out = meta.join(copies, ["fp1", "fp2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")))
    out = out.join(label.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs, all columns, with one document of each component: its smallest id. Rows without an id stay; of rows that repeat an id one stays."""
    away = materialize(join(docs, id, text, **options).filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("_away")), "away")
    out = docs.join(away, docs[id] == away["_away"], "left_anti")
    if not docs.filter(F.col(id).isNotNull()).groupBy(id).count().filter("count > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy(id).orderBy(F.xxhash64(text), text))
        name = free_name("_rank", docs.columns)
        out = out.withColumn(name, F.when(F.col(id).isNull(), 1).otherwise(rank)).filter(F.col(name) == 1).drop(name)
    return out


def free_name(name: str, columns: list[str]) -> str:
    """name, with as many underscores in front as no column has."""
    while name in columns:
        name = "_" + name
    return name


def op1(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
