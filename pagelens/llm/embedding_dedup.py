"""Near-duplicate vectors by dual traversal of cover trees: all pairs with a cosine of at least `least`, exactly.

On unit vectors the cosine bounds a Euclidean distance. Vectors go to the nearest of a bounded number of centres, and each centre's
cell to blocks of at most about `block` vectors; cells whose centres are farther apart than their radii and the limit together share
no pair. For every other pair of blocks, a join of small tables, one task builds a cover tree of each (nested levels whose radii halve,
down to a few vectors or single ones) and walks both at once: node pairs that the covering radii keep apart are dropped, node pairs that
lie within the limit as a whole are counted as a whole, and single vectors are decided by the cosine in double precision. A task returns
link counts and a spanning forest of its links.

Where vectors have no structure (random directions), a net at half the radius has every vector as a node of its own; then the pairs of
such nodes are all there is to walk, in one matrix product of blocks, and work grows with the square of the vectors.

Equal vectors are one while trees are built, and count as many as they are.

Defined cases: null, zero and empty vectors, and those with null or non-finite components, link with nothing; vectors of different
lengths do not link; rows that repeat an id count as the one with the smallest fingerprint; rows without an id are left out; an
empty table gives no rows; vectors of any length are taken whole; labels and other columns are never looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U, column, components, grouped, labels, mapped, materialize, mix, partitions

LEAF, SLACK = 24, 1e-7  # distances come from products, whose last bits count for 2e-8 where they are near 0


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _away(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * dots))


class CoverTree:
    """Nodes over the rows of x, which `order` sorts so that a node's rows are order[start:end]; radius: of all rows of a node around its centre."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.order = np.arange(len(x))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        if len(x):
            todo = [(self._node(0, len(x)), 1.0)]  # all distances are at most 2
            while todo:
                node, r = todo.pop()
                todo += self._grow(node, r)
        self.centres = x[self.centre] if self.centre else np.zeros((0, x.shape[1]))
        self.radii, self.sizes = np.array(self.radius), np.array([b - a for a, b in self.span], np.int64)
        self.inner = np.array([len(k) > 0 for k in self.children], bool)
        self.starts = np.array([a for a, _ in self.span], np.int64)
        self.short = x.astype(np.float32)

    def rows(self, nodes) -> np.ndarray:
        """The rows of all of some nodes."""
        size, start = self.sizes[nodes], self.starts[nodes]
        edge = np.cumsum(size)
        return self.order[np.repeat(start - edge + size, size) + np.arange(edge[-1] if len(edge) else 0)]

    def _node(self, start: int, end: int) -> int:
        """A node around its first row."""
        rows = self.order[start:end]
        self.centre.append(int(rows[0]))
        self.radius.append(float(_away(self.x[rows] @ self.x[rows[0]]).max()) if len(rows) > 1 else 0.0)
        self.span.append((start, end))
        self.children.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _grow(self, node: int, r: float) -> list[tuple[int, float]]:
        """Children at the largest halved radius that parts the node; the first one keeps its centre."""
        start, end = self.span[node]
        if end - start <= self.leaf:
            return []
        rows = self.order[start:end].copy()
        while r > SLACK:
            of = self._net(rows, r)
            if of.any():
                break
            r /= 2
        else:
            return []  # rows that differ in their last bits
        by = np.argsort(of, kind="stable")
        self.order[start:end] = rows[by]
        cuts = np.flatnonzero(np.diff(of[by], prepend=-1)).tolist()
        kids = [self._node(start + a, start + b) for a, b in zip(cuts, [*cuts[1:], end - start])]
        self.children[node] = np.array(kids, np.int64)
        return [(k, r / 2) for k in kids]

    def _net(self, rows: np.ndarray, r: float, step: int = 256) -> np.ndarray:
        """For each row, the number of the net's centre whose ball of radius r has it; centres are more than r apart, the first is rows[0]."""
        least, of, centres = 1 - r * r / 2, np.empty(len(rows), np.int64), []
        for a in range(0, len(rows), step):
            own = self.x[rows[a : a + step]]
            at = np.full(len(own), -1)
            if centres:
                dots = own @ self.x[centres].T
                best = dots.argmax(axis=1)
                at = np.where(dots[np.arange(len(own)), best] >= least, best, -1)
            left = np.flatnonzero(at < 0)
            near = own[left] @ own[left].T >= least
            np.fill_diagonal(near, True)
            free = np.ones(len(left), bool)
            for i in range(len(left)):
                if free[i]:
                    at[left[near[i] & free]] = len(centres)
                    free &= ~near[i]
                    centres.append(rows[a + left[i]])
            of[a : a + len(own)] = at
        return of


class Links:
    """Links of every row of p (weighed by wq) and of q (by wp), and the component of each row, q's after p's, by dual traversal.

    decided: products that decided a pair of vectors; whole: pairs of vectors counted by their nodes.
    """

    def __init__(self, p: CoverTree, q: CoverTree, wp: np.ndarray, wq: np.ndarray, least: float):
        self.p, self.q, self.wp, self.wq, self.least = p, q, wp, wq, least
        self.limit = math.sqrt(max(0.0, 2 - 2 * least))
        self.of_p, self.of_q = np.zeros(len(p.x), np.int64), np.zeros(len(q.x), np.int64)
        self.ea: list[np.ndarray] = []
        self.eb: list[np.ndarray] = []
        self.held = self.decided = self.whole = 0
        todo = [(0, 0)] if len(p.x) and len(q.x) else []
        while todo:
            todo += self._open(*todo.pop())

    def _edges(self, a: np.ndarray, b: np.ndarray) -> None:
        self.ea.append(a)
        self.eb.append(b + len(self.of_p))
        self.held += len(a)
        if self.held > 2_000_000:  # only a spanning forest is kept
            label = self.labels()
            own = np.flatnonzero(label != np.arange(len(label)))
            self.ea, self.eb, self.held = [own], [label[own]], len(own)

    def labels(self) -> np.ndarray:
        none = [np.zeros(0, np.int64)]
        return labels(len(self.of_p) + len(self.of_q), np.concatenate(self.ea or none), np.concatenate(self.eb or none))

    def _linked(self, x: np.ndarray, y: np.ndarray) -> None:
        """All vectors x of p are linked with all y of q."""
        self.whole += len(x) * len(y)
        self.of_p[x] += self.wq[y].sum()
        self.of_q[y] += self.wp[x].sum()
        self._edges(np.concatenate([x, np.full(len(y), x[0])]), np.concatenate([np.full(len(x), y[0]), y]))

    def _rows(self, x: np.ndarray, y: np.ndarray) -> None:
        """Vectors x of p and y of q, decided one by one: in single precision, then in double where that comes near the limit."""
        if not len(x) or not len(y):
            return
        p, q, least = self.p, self.q, self.least
        margin = 1e-6 + 2**-23 * p.x.shape[1]  # of a product of unit vectors in single precision
        other = q.short[y].T
        for k in range(0, len(x), step := max(1, 4_000_000 // len(y))):
            own = x[k : k + step]
            hit = p.short[own] @ other >= least - margin
            self.decided += hit.size
            n = np.count_nonzero(hit)
            if not n:
                continue
            if n > hit.size // 16:
                hit = p.x[own] @ q.x[y].T >= least
                self.of_p[own] += hit @ self.wq[y]
                self.of_q[y] += self.wp[own] @ hit
                u, v = np.nonzero(hit)
                self._edges(own[u], y[v])
                continue
            u, v = np.nonzero(hit)
            u, v = own[u], y[v]
            sure = np.einsum("ij,ij->i", p.x[u], q.x[v]) >= least
            u, v = u[sure], v[sure]
            self.of_p += np.bincount(u, self.wq[v], len(self.of_p)).astype(np.int64)
            self.of_q += np.bincount(v, self.wp[u], len(self.of_q)).astype(np.int64)
            self._edges(u, v)

    def _open(self, i: int, j: int) -> list[tuple[int, int]]:
        p, q = self.p, self.q
        a, b = p.children[i], q.children[j]
        # of two inner nodes only the wider is opened, unless they are alike
        wide = len(a) and len(b) and (1 if p.radii[i] > 1.5 * q.radii[j] else -1 if q.radii[j] > 1.5 * p.radii[i] else 0)
        if not len(a) or wide < 0:
            a = np.array([i])
        if not len(b) or wide > 0:
            b = np.array([j])
        one_a, one_b = p.sizes[a] == 1, q.sizes[b] == 1
        self._rows(p.rows(a[one_a]), q.rows(b[one_b]))
        return [*self._nodes(a[~one_a], b), *self._nodes(b[~one_b], a[one_a], turned=True)]

    def _nodes(self, a: np.ndarray, b: np.ndarray, turned: bool = False) -> list[tuple[int, int]]:
        """Nodes a of p, or turned of q, with several vectors, against nodes b of the other tree: node pairs to open."""
        p, q = (self.q, self.p) if turned else (self.p, self.q)
        out = []
        if not len(b):
            return out
        for own in np.array_split(a, -(-len(a) * len(b) // 1_000_000)) if len(a) else []:
            dots = p.centres[own] @ q.centres[b].T
            reach = self.limit + SLACK + p.radii[own][:, None] + q.radii[b][None, :]
            near = dots >= 1 - reach * reach / 2
            inner = q.inner[b]
            for u in range(len(own)):
                if p.inner[own[u]]:
                    some = b[near[u] & inner]
                    whole = _away(dots[u][near[u] & inner]) + p.radii[own[u]] + q.radii[some] <= self.limit - SLACK
                    for k in some[whole].tolist():
                        self._turned(self._linked, p.rows(own[u : u + 1]), q.rows(np.array([k])), turned)
                    out += [(k, int(own[u])) if turned else (int(own[u]), k) for k in some[~whole].tolist()]
                    if len(some := b[near[u] & ~inner]):
                        self._descend(int(own[u]), q.rows(some), turned)
                    continue
                if len(some := b[near[u] & ~inner]):
                    self._turned(self._rows, p.rows(own[u : u + 1]), q.rows(some), turned)
                for k in b[near[u] & inner].tolist():
                    self._descend(k, p.rows(own[u : u + 1]), not turned)
        return out

    @staticmethod
    def _turned(what, x: np.ndarray, y: np.ndarray, turned: bool) -> None:
        what(*((y, x) if turned else (x, y)))

    def _descend(self, node: int, rows: np.ndarray, turned: bool) -> None:
        """A node's vectors, of p or, turned, of q, against single vectors of the other tree."""
        tree, other = (self.q, self.p) if turned else (self.p, self.q)
        todo = [(node, rows)]
        while todo:
            node, rows = todo.pop()
            d = _away(other.x[rows] @ tree.centres[node])
            whole = d + tree.radii[node] <= self.limit - SLACK
            if whole.any():
                self._turned(self._linked, tree.rows(np.array([node])), rows[whole], turned)
            rows = rows[~whole & (d <= self.limit + tree.radii[node] + SLACK)]
            if not len(rows):
                continue
            if tree.inner[node]:
                todo += [(k, rows) for k in tree.children[node].tolist()]
            else:
                self._turned(self._rows, tree.rows(np.array([node])), rows, turned)


def _read(vectors: DataFrame, width: str) -> DataFrame:
    """(id, ok, size, fp1, fp2, v): v as bytes."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("id", "ok", "size", "fp1", "fp2", "v")}
            for k, v in zip(column(batch, "id"), column(batch, "v")):
                x = np.array([math.nan if c is None else c for c in v or []], width)
                ok = bool(len(x)) and bool(np.isfinite(x).all()) and bool(x.any())
                raw = (x + x.dtype.type(0)).tobytes()  # -0 as 0
                f = xxhash.xxh3_128_intdigest(raw)
                for name, y in zip(out, (k, ok, len(x), (f >> 64) - (1 << 63), (f & (1 << 64) - 1) - (1 << 63), raw)):
                    out[name].append(y)
            yield out

    return mapped(vectors, run, "id long, ok boolean, size int, fp1 long, fp2 long, v binary")


def _far_first(x: np.ndarray, count: int) -> np.ndarray:
    """Centres, each the row farthest from those before."""
    chosen = [0]
    d = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < count and d.max() > 1e-12:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", *, least: float = 0.9, block: int = 8192, most_centres: int = 256, sample: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector. sample: rows that the centres are chosen from; every row is compared."""
    spark = vectors.sparkSession
    width = "<f8" if "double" in vectors.schema[vector].dataType.simpleString() else "<f4"
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull())
    read = _read(rows, width)
    table = materialize(read.groupBy("id").agg(F.min(F.struct("fp1", "fp2", "ok", "size", "v")).alias("x")).select("id", "x.*"), "vectors")
    classes = materialize(table.filter("ok").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    reps = materialize(table.filter("ok").select("id", "size", "v").join(classes.select(F.col("rep").alias("id"), "m"), "id"), "reps")
    sizes = [(r["size"], r["n"]) for r in reps.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()]
    if not sizes:
        return table.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    size, n = sizes[0]
    picked = reps.filter(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    units = _unit(np.stack([np.frombuffer(bytes(r.v), width) for r in picked]))
    centres = _far_first(units, int(min(most_centres, max(1, -(-n // block)))))
    said = spark.sparkContext.broadcast(centres)

    def cell_of(batch):
        """Cell, distance to its centre, and unit vectors; vectors of other lengths share cells below 0, one for each length."""
        raw, size_ = column(batch, "v"), np.array(column(batch, "size"))
        cell, far = np.zeros(len(raw), np.int64), np.full(len(raw), 2.0)
        for s in np.unique(size_).tolist():
            at = np.flatnonzero(size_ == s)
            if s != size:
                cell[at] = -s
                continue
            x = _unit(np.stack([np.frombuffer(raw[i], width) for i in at]))
            dot = x @ said.value.T
            cell[at] = dot.argmax(axis=1)
            far[at] = np.linalg.norm(x - said.value[cell[at]], axis=1)
        return cell, far, raw

    def measure(batches):
        for batch in batches:
            if batch.num_rows:
                cell, far, _ = cell_of(batch)
                k, back = np.unique(cell, return_inverse=True)
                r = np.zeros(len(k))
                np.maximum.at(r, back, far)
                yield {"cell": k, "n": np.bincount(back), "r": r}

    cells = mapped(reps, measure, "cell long, n long, r double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r")).orderBy("cell").collect()  # one row for a centre or a length
    split = {r.cell: int(-(-r.n // block)) for r in cells}
    radius = {r.cell: r.r for r in cells}
    limit = math.sqrt(max(0.0, 2 - 2 * least))
    near = [(c, e) for i, c in enumerate(split) for e in [*split][i:] if c == e or c >= 0 and e >= 0 and np.linalg.norm(centres[c] - centres[e]) <= limit + radius[c] + radius[e] + SLACK]
    count = sum(split[c] * split[e] if c != e else split[c] * (split[c] + 1) // 2 for c, e in near)

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, _, raw = cell_of(batch)
            ids, m = np.array(column(batch, "id")), np.array(column(batch, "m"))
            part = (mix(ids.astype(np.int64).view(U)) % np.array([split[c] for c in cell.tolist()], U)).astype(np.int64)
            out = {k: [] for k in ("cell", "part", "ids", "m", "v")}
            for c, k in sorted(set(zip(cell.tolist(), part.tolist()))):
                at = np.flatnonzero((cell == c) & (part == k))
                for name, y in zip(out, (c, k, ids[at].tobytes(), m[at].tobytes(), b"".join(raw[i] for i in at.tolist()))):
                    out[name].append(y)
            yield out

    pieces = materialize(mapped(reps, deal, "cell long, part long, ids binary, m binary, v binary"), "pieces")
    blocks = spark.createDataFrame(list(split.items()), "cell long, parts long").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    x, y = (blocks.select(F.col("cell").alias(f"c{i}"), F.col("part").alias(f"k{i}")) for i in (1, 2))
    pairs = spark.createDataFrame(near, "c1 long, c2 long").join(x, "c1").join(y, "c2").filter("c1 <> c2 or k1 <= k2")
    pairs = pairs.withColumn("pair", F.concat_ws("/", "c1", "k1", "c2", "k2"))
    sides = pairs.select("pair", F.lit(0).alias("side"), F.col("c1").alias("cell"), F.col("k1").alias("part"))
    sides = sides.union(pairs.filter("c1 <> c2 or k1 <> k2").select("pair", F.lit(1), "c2", "k2"))

    def compare(batches):
        for _, group in grouped(batches, "pair"):
            sides: list[list] = [[], []]
            for batch in group:
                for side, *x in zip(*(column(batch, k) for k in ("side", "ids", "m", "v"))):
                    sides[side].append(x)
            trees = []
            for side in sides:
                if side:
                    ids = np.concatenate([np.frombuffer(x[0], np.int64) for x in side])
                    m = np.concatenate([np.frombuffer(x[1], np.int64) for x in side])
                    order = np.argsort(ids)
                    v = np.concatenate([np.frombuffer(x[2], width).reshape(len(x[0]) // 8, -1) for x in side])
                    trees.append((ids[order], m[order], CoverTree(_unit(v[order]))))
            one, two = trees[0], trees[-1]
            both = Links(one[2], two[2], one[1], two[1], least)
            a, b, label = both.of_p, both.of_q, both.labels()
            ids = np.concatenate([one[0], two[0]])
            if len(trees) == 1:
                found = [(one[0], a - one[1])]  # each vector met itself
            else:
                found = [(one[0], a), (two[0], b)]
            for k, n_ in found:
                keep = n_ > 0
                yield {"a": k[keep], "b": [None] * int(keep.sum()), "n": n_[keep]}
            own = np.flatnonzero((ids[label] != ids))
            yield {"a": ids[own], "b": ids[label[own]], "n": [0] * len(own)}

    dealt = pieces.join(sides, ["cell", "part"]).select("pair", "side", "ids", "m", "v").repartition(max(partitions(spark), min(count, 1 << 16)), "pair").sortWithinPartitions("pair")
    links = materialize(mapped(dealt, compare, "a long, b long, n long"), "links")
    label = components(links.filter("b is not null").select("a", "b"))
    count = links.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = materialize(classes.join(count, "rep", "left").join(label.select(F.col("id").alias("rep"), "component"), "rep", "left"), "found")
    out = table.join(found, ["fp1", "fp2"], "left")
    n_links = F.when(F.col("ok"), F.coalesce("n", F.lit(0)) + F.col("m") - 1).otherwise(0).cast("long")
    component = F.when(F.col("ok"), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), n_links.alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
