"""Packed token ids for training: best-fit-decreasing packing with a segment tree over free capacity.

Documents are tokenized whole, ended by an end id and packed into rows of at most `room` tokens. Only a document longer than that
is cut, without loss, into pieces of `room` tokens of which the first may be shorter. A row is a line of the id matrix, padded to `room`,
with the cumulative lengths of its segments, the positions that start at 0 in every segment, and each segment's document, piece and start.

Packing takes place where the documents are read, over as many of them as `buffer` tokens hold: nothing is shuffled, memory is
bounded, and a lost task repeats only its own part. Row numbers hold the partition's number and a counter.

Defined cases: a null or empty text is one segment with the end id alone; a text of any length is cut whole; equal lengths are packed
in reading order; an empty table gives no rows; rows that repeat an id are packed one by one; other columns are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunked, column, mapped
from .tokens import END, encoder, pieces


class CapacityTree:
    """Open bins by free room; the fullest bin that an item still fits is found by descent from the root."""

    def __init__(self, room: int):
        self.size = 1 << room.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, bin: int) -> None:
        self.bins[free].append(bin)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """A bin with the least free room >= need, taken out of the tree."""
        i, count = need + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.size
        bin = self.bins[free].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return free, bin


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Bins of item numbers; every item has 1 to room tokens."""
    tree, out = CapacityTree(room), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = tree.take(n)
        free, bin = got if got else (room, len(out))
        if got:
            out[bin].append(k)
        else:
            out.append([k])
        if free > n:
            tree.add(free - n, bin)
    return out


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", *, room: int = 1024, tokenizer: str | None = None, buffer: int = 16_000_000, end: int = END, pad: int = 0) -> DataFrame:
    """One row for each packed sequence, a line of the id matrix: input_ids and position_ids of `room` numbers each, n_tokens of them
    used and the others `pad` and 0; cu_seqlens from 0 to n_tokens; and for each segment doc_ids, pieces and starts."""
    kind = docs.schema[id].dataType.simpleString()
    names = ("sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "pieces", "starts")

    def emit(items, data, seq):
        lengths = np.array([x[3] for x in items], np.int64)
        out = {k: [] for k in names}
        for bin in best_fit_decreasing(lengths, room):
            own = [items[k] for k in bin]
            edges = [0, *np.cumsum([x[3] for x in own]).tolist()]
            ids, pos = np.full(room, pad, np.int32), np.zeros(room, np.int32)
            for x, a, b in zip(own, edges, edges[1:]):
                ids[a:b] = np.frombuffer(data[x[4]], "<u4", x[3], 4 * x[2])
                pos[a:b] = steps[: b - a]
            for name, v in zip(names, (next(seq), edges[-1], ids, pos, edges, [x[0] for x in own], [x[1] for x in own], [x[2] for x in own])):
                out[name].append(v)
            if len(out["n_tokens"]) >= 500:
                yield out
                out = {k: [] for k in names}
        yield out

    steps = np.arange(room, dtype=np.int32)

    def run(batches):
        part = TaskContext.get().partitionId()
        seq = iter(range(part << 33, (part + 1) << 33))
        encode, items, data, held = encoder(tokenizer), [], [], 0
        for batch in chunked(batches, limit=2_000_000):
            for k, ids in zip(column(batch, "id"), encode(column(batch, "text"))):
                ids += end.to_bytes(4, "little")
                items += [(k, i, s, n, len(data)) for i, (s, n) in enumerate(pieces(len(ids) // 4, room))]
                data.append(ids)
                held += len(ids) // 4
                if held >= buffer:
                    yield from emit(items, data, seq)
                    items, data, held = [], [], 0
        if items:
            yield from emit(items, data, seq)

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return mapped(rows, run, f"sequence_id long, n_tokens int, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<long>")


def write(packed: DataFrame, path: str, **options: str) -> None:
    """Write packed rows as Parquet, through Spark's committer, so that a repeated task leaves no double rows."""
    packed.write.options(**options).mode("overwrite").parquet(path)


def op6(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
