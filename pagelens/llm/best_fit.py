"""Hierarchical residual packing of token sequences.

Each partition packs its pieces best-fit; bins that are nearly full are final, the others go up a tree as items: the bins of a few
partitions meet and are packed again, round by round, until one group is left. A group is bounded: where a node of the tree would hold
too many bins, they are dealt to more groups by a hash that changes with the round. Only lengths travel, never ids: a round's table maps
bins to the bins that took them in and their offset there, and at the end each piece follows its chain.

Defined cases: a null or empty text is one piece with the end id alone; texts of any length are cut whole, a batch of about 2 MB of them
or one text at a time; an empty table gives no rows; rows that repeat an id are packed one by one; equal lengths in order of id and
piece; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._common import chunked, column, mapped, materialize, partitions
from .tokens import END, encoder, pieces


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Longest first, each into the fullest bin that it fits: bin and offset of every item, and the fill of every bin."""
    bin_of, offset, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0  # bit c is set where a bin has c tokens free
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        if fits := mask >> n:
            c = n + (fits & -fits).bit_length() - 1
            b = open_at[c].pop()
            if not open_at[c]:
                mask &= ~(1 << c)
            c -= n
        else:
            b, c = len(fill), room - n
            fill.append(0)
        bin_of[k], offset[k] = b, fill[b]
        fill[b] += n
        if c:
            open_at[c].append(b)
            mask |= 1 << c
    return bin_of, offset, fill


def cut(docs: DataFrame, id: str = "doc_id", text: str = "text", *, room: int = 1024, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in chunked(batches, limit=2_000_000):
            out = {k: [] for k in ("id", "piece", "start", "length", "ids_crc32")}
            for k, ids in zip(column(batch, "id"), encode(column(batch, "text"))):
                ids += end.to_bytes(4, "little")
                for i, (s, n) in enumerate(pieces(len(ids) // 4, room)):
                    for name, v in zip(out, (k, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]))):
                        out[name].append(v)
            yield out

    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return mapped(rows, run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, *, room: int = 1024, nearly: float = 0.99, fan_in: int = 16, first: int | None = None, per_group: int = 100_000, least: int = 2048, gain: float = 0.01) -> DataFrame:
    """items (id, piece, length, others), a table already written, with the columns sequence_id and offset added or replaced.

    nearly: bins at least so full are final before the last round. first: groups of the first round; without it, enough that one has
    `per_group` items on average, and on small inputs as many as there are shuffle partitions while each keeps `least`. A round joins
    `fan_in` groups; where that would make them larger than `per_group` bins, bins are dealt anew instead, so that others meet. Rounds
    end with one group, or when a round over dealt bins has saved less than the share `gain` of them.
    """
    spark = items.sparkSession
    n = items.count()
    groups = first or max(1, -(-n // per_group), min(partitions(spark), n // least))
    own = items.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(items.columns)])  # names of ours cannot clash with theirs
    id, piece, length = (f"c{items.columns.index(c)}" for c in ("id", "piece", "length"))
    base = own.withColumn("_group", F.pmod(F.xxhash64(id, piece), F.lit(groups)).cast("int"))

    def round0(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id, piece], kind="stable")
        b, o, _ = best_fit(pdf[length].to_numpy(), room)
        return pdf.assign(_bin=b + (pdf["_group"].to_numpy().astype(np.int64) << 28), _offset=o)

    schema = StructType([*base.schema.fields, StructField("_bin", LongType()), StructField("_offset", LongType())])
    at = materialize(base.groupBy("_group").applyInPandas(round0, schema), "pack0")
    level, open_bins = 0, _under(at.groupBy("_bin").agg(F.sum(length).alias("fill"), F.first("_group").alias("_group")), room, nearly)
    chains, before, kept = [], groups, None
    while before > 1:
        waiting = open_bins.count()
        tree = -(-before // fan_in)
        groups = max(tree, -(-waiting // per_group))
        dealt = groups > tree  # a node of the tree would be too large
        if not waiting or dealt and kept is not None and waiting > (1 - gain) * kept:
            break
        level, before, kept = level + 1, groups, waiting if dealt else None
        place = F.pmod(F.xxhash64("_bin", F.lit(level)), F.lit(groups)) if dealt else F.floor(F.col("_group") / fan_in)
        into = open_bins.withColumn("_group", place.cast("int"))
        into = materialize(into.groupBy("_group").applyInPandas(_merge(level, room), "_child long, _bin long, _add long, fill long, _group int"), f"pack{level}")
        chains.append(into)
        open_bins = _under(into.groupBy("_bin").agg(F.sum("fill").alias("fill"), F.first("_group").alias("_group")), room, nearly)
    out = at
    for into in chains:
        step = into.select("_child", F.col("_bin").alias("_into"), "_add")
        out = out.join(step, out._bin == step._child, "left").withColumn("_bin", F.coalesce("_into", "_bin")).withColumn("_offset", F.col("_offset") + F.coalesce("_add", F.lit(0))).drop("_child", "_into", "_add")
    kept_columns = [F.col(f"c{i}").alias(c) for i, c in enumerate(items.columns) if c not in ("sequence_id", "offset")]
    return out.select(*kept_columns, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset"))


def _merge(level: int, room: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bin", kind="stable")
        b, o, _ = best_fit(pdf["fill"].to_numpy(), room)
        return pd.DataFrame({"_child": pdf["_bin"], "_bin": b + (pdf["_group"].to_numpy().astype(np.int64) << 28) + (level << 56), "_add": o, "fill": pdf["fill"], "_group": pdf["_group"]})

    return merge


def _under(bins: DataFrame, room: int, nearly: float) -> DataFrame:
    return bins.filter(F.col("fill") < nearly * room).select("_bin", "fill", "_group")


def sequences(docs: DataFrame, id: str = "doc_id", text: str = "text", *, room: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialize(cut(docs, id, text, room=room, tokenizer=tokenizer), "pieces"), room=room).withColumnRenamed("id", id)


def op9(spark, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
