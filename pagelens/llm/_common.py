"""What the operators of this folder share: tables in the shared folder, byte words, hashes and components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Upper-case ASCII letters to lower case, everything else unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; executors and driver need a folder that all of them see")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="pagelens-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor then costs no recomputation, and lineage ends here.

    by: a column to lay the files out by, so that forget() can remove one of its values.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagelens_path = path
    return out


def forget(df: DataFrame, part: str = "") -> None:
    """Remove a materialized table, or a part such as kind=T of it, that no later plan reads."""
    path = getattr(df, "_pagelens_path", None)
    if path:
        path = f"{path}/{part}"
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs: Spark deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(spark: SparkSession, size: int, each: int, most: int = 4096) -> int:
    """Buckets for `size` bytes or rows with about `each` in one: at least as many as there are shuffle partitions."""
    return max(partitions(spark), min(most, -(-size // each)))


def deal(df: DataFrame, n: int, key: str = "bucket", *order: str) -> DataFrame:
    """df with every key 0 to n - 1 in a partition of its own, sorted by key and `order` in it: no two keys collide as they do by hash."""
    return df.repartitionById(n, F.col(key).cast("int")).sortWithinPartitions(key, *order)


def scan_splits(df: DataFrame, least: int | None = None) -> DataFrame:
    """df, dealt out evenly when its scan has fewer partitions than the cluster has cores."""
    n = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def chunked(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about `limit` bytes of text: memory stays bounded whatever the batch size is."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        else:
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    col = batch.column(batch.schema.get_field_index(text))
    binary = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(binary).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh3_64_intdigest, words), U, len(words))


def window_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, U(0x9E3779B97F4A7C15) + U(seed))
    for i in range(k):
        out = mix(out ^ h[i : n + i]) + U(0x2545F4914F6CDD1D)
    return out


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n, the smallest number in its component over edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def _one_task(batches):
    a, b = [], []
    for batch in batches:
        a.append(np.asarray(batch.column(0), np.int64))
        b.append(np.asarray(batch.column(1), np.int64))
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        yield {"id": ids, "component": ids[labels(len(ids), at[: len(a)], at[len(a) :])]}


def components(edges: DataFrame, one_task: int = 500_000) -> DataFrame:
    """Connected components of edges (a, b) of long ids: (id, component) with the smallest id of each; only ids on edges.

    Up to `one_task` edges, a checked number, are one task's work. More take alternating large-star and small-star contraction, entirely in DataFrame operations: every round halves distances, and its
    table goes to the shared folder, so a lost executor repeats one round. Joins may be split by adaptive execution where one id
    has very many neighbours; no component is ever gathered in one place.
    """
    cur = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    if cur.count() <= one_task:
        return materialize(mapped(cur.coalesce(1), _one_task, "id long, component long"), "components")
    before = None
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).filter("b > a").select(F.col("m").alias("a"), F.col("b"))
        large = materialize(large.filter("a < b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m")
        small = large.join(low, large.b == low.k).select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        new = materialize(small.filter("a < b").distinct(), "small")
        stat = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = (stat.n, stat.s)
        forget(large)
        forget(cur)
        cur = new
        if now == before:
            # a fixpoint is a set of stars: every id points to its component's smallest
            return cur.select(F.col("b").alias("id"), F.col("a").alias("component")).union(cur.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
        before = now


def grouped(batches: Iterable[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of equal keys of a partition sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cuts, cuts[1:]):
            if held and k[a] != now:
                yield now, held
                held = []
            now = k[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with fn(iterator of batches) giving dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        for out in fn(batches):
            if out and len(next(iter(out.values()))):
                yield pa.record_batch([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
