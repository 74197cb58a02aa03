"""URL filter: a blocked Bloom filter over listed keys passes possible hits to an exact hash join.

A list holds rules (host, path, verdict) and canonical URLs. A rule fits its host, all its subdomains and all paths that start with its
own; the longest rule that fits decides, and without one a URL is blocked if its canonical form is listed. Every URL is looked
up by its few possible keys (host suffixes with path starts of the lengths that rules have, and the canonical form); the filter,
of bounded size whatever the list's, drops nearly all keys that are not listed, and the join removes its false positives.

Defined cases: URLs of any length are looked up whole; a null URL or one without `://` has an empty host and path, fits no rule and is allowed; an empty list allows
all; rules of equal length are decided by the longer host, then by block; every input row gives one output row, repeated ones
too; other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U, column, deal, grouped, mapped, mix, partitions

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Canonical URLs that the query blocks where no rule fits.
LISTED = ("thther.example.org/en/685", "ererth.example.org/fr/12", "ththth.example.org/", "ththre.example.org/de/77", "theand.example.org/es/401?page=2&ref=x")


@dataclass
class Bloom:
    """Blocks of eight 64-bit words; a key sets one bit in each word of one block."""

    words: np.ndarray

    @staticmethod
    def places(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
        return Bloom.places_of(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), U, len(keys)), blocks)

    @staticmethod
    def places_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """As places, for keys that are hashes already."""
        g = mix(h)
        lane = np.arange(8, dtype=U)
        bit = (g[:, None] >> (lane * U(6))[None, :]) & U(63)
        return Bloom.blocks_of(h, blocks)[:, None] * 8 + lane.astype(np.int64)[None, :], U(1) << bit

    @staticmethod
    def blocks_of(h: np.ndarray, blocks: int) -> np.ndarray:
        return ((h >> U(16)) % U(blocks)).astype(np.int64)

    @classmethod
    def build(cls, keys: DataFrame, bits_per_key: int = 16, most_bytes: int = 32 << 20) -> Bloom:
        """From the column key (strings, or longs that are hashes); the filter has at most most_bytes. Keys go by their place to tasks that
        set a segment's bits; only the segments come to the driver, as bytes."""
        hashed = keys.schema["key"].dataType.simpleString() == "bigint"
        n = keys.count()
        blocks = int(max(1, min(most_bytes // 64, -(-n * bits_per_key // 512))))
        segments = max(1, min(partitions(keys.sparkSession), blocks // 1024))
        each = -(-blocks // segments)

        def emit(batches):
            for batch in batches:
                if hashed:
                    h = np.asarray(batch.column(0), np.int64).view(U)
                else:
                    h = np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in column(batch, "key") if k is not None), U)
                segment = cls.blocks_of(h, blocks) // each
                order = np.argsort(segment, kind="stable")
                at, first = np.unique(segment[order], return_index=True)
                yield {"segment": at, "hashes": [x.tobytes() for x in np.split(h[order], first[1:])] if len(at) else []}

        def fill(batches):
            for segment, group in grouped(batches, "segment"):
                low = int(segment) * each
                words = np.zeros(min(each, blocks - low) * 8, U)
                for h in (np.frombuffer(x, U) for b in group for x in column(b, "hashes")):
                    for i in range(0, len(h), 100_000):
                        at, mask = cls.places_of(h[i : i + 100_000], blocks)
                        np.bitwise_or.at(words, at - low * 8, mask)
                yield {"segment": [segment], "words": [words.tobytes()]}

        rows = deal(mapped(keys.select("key"), emit, "segment int, hashes binary"), segments, "segment")
        words = np.zeros(blocks * 8, U)
        for r in mapped(rows, fill, "segment int, words binary").collect():
            own = np.frombuffer(r.words, U)
            words[r.segment * each * 8 :][: len(own)] = own
        return cls(words)

    def has_hashes(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for i in range(0, len(h), 100_000):
            at, mask = self.places_of(h[i : i + 100_000], len(self.words) // 8)
            out[i : i + 100_000] = ((self.words[at] & mask) == mask).all(axis=1)
        return out

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        at, mask = self.places(keys, len(self.words) // 8)
        return ((self.words[at] & mask) == mask).all(axis=1)


def parts(url: str | None) -> tuple[str, str, str, str]:
    """Scheme and host with A-Z lower-cased, path, and query without its mark."""
    if url is None or (i := url.find("://")) < 0:
        return "", "", "", ""
    host, path, query = re.match(r"([^/?#]*)([^?#]*)(?:\?([^#]*))?", url[i + 3 :]).groups()
    return url[:i].encode().lower().decode(), host.encode().lower().decode(), path, query or ""


def canonical(scheme: str, host: str, path: str, query: str) -> str:
    """Without the scheme, a leading www., the scheme's own port and a fragment."""
    host = host.removeprefix("www.").removesuffix({"http": ":80", "https": ":443"}.get(scheme, "\0"))
    return host + (path or "/") + (f"?{query}" if query else "")


def rules_table(spark: SparkSession, rules=RULES, listed=LISTED) -> DataFrame:
    rows = [("r:" + h + p, h + p, v, len(h + p), len(h), len(p)) for h, p, v in rules] + [("u:" + u, None, "block", -1, 0, -1) for u in listed]
    return spark.createDataFrame(rows, "key string, rule string, said string, size int, host_size int, path_size int")


def judge(pages: DataFrame, table: DataFrame, id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row of pages."""
    spark = pages.sparkSession
    sizes = sorted(r[0] for r in table.filter("path_size >= 0").select("path_size").distinct().collect())  # lengths, not rules
    said = spark.sparkContext.broadcast(Bloom.build(table))
    kind = pages.schema[id].dataType.simpleString()

    def run(batches):
        bloom, row = said.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            out = {k: [] for k in ("row", "id", "host", "path", "keys")}
            keys: list[str] = []
            ends: list[int] = []
            for k, u in zip(column(batch, "id"), column(batch, "url")):
                scheme, host, path, query = parts(u)
                if host:
                    labels = host.split(".")
                    for i in range(len(labels)):
                        suffix = "r:" + ".".join(labels[i:])
                        keys += [suffix + path[:s] for s in sizes if s <= len(path)]
                    keys.append("u:" + canonical(scheme, host, path, query))
                ends.append(len(keys))
                for name, v in zip(out, (row, k, host, path)):
                    out[name].append(v)
                row += 1
            hit = bloom.has([k.encode() for k in keys])
            at = 0
            for e in ends:
                out["keys"].append([keys[j] for j in range(at, e) if hit[j]])
                at = e
            yield out

    rows = mapped(pages.select(F.col(id).alias("id"), F.col(url).alias("url")), run, f"row long, id {kind}, host string, path string, keys array<string>")
    hits = rows.withColumn("key", F.explode_outer("keys")).drop("keys").join(table, "key", "left")
    best = F.max(F.when(F.col("size") >= 0, F.struct("size", "host_size", (F.col("said") == "block").alias("block"), "rule", "said")))
    out = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("b"), F.coalesce(F.bool_or(F.col("size") < 0), F.lit(False)).alias("listed"))
    verdict = F.coalesce("b.said", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id), "host", "path", F.col("b.rule").alias("rule"), verdict.alias("verdict"), "listed")


def op3(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, rules_table(spark)).drop("listed")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
_LISTED = ", ".join(f"'{u}'" for u in LISTED)
OP3_SQL = f"""
WITH rules(rh, rp, said) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, url, row_number() OVER () AS r, translate(substr(url, 1, greatest(0, position('://' IN url) - 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS scheme, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, r, scheme, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '') AS query FROM cut),
hit AS (SELECT r, rh || rp AS rule, said, row_number() OVER (PARTITION BY r ORDER BY length(rh || rp) DESC, length(rh) DESC, said DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host <> '' AND regexp_replace(regexp_replace(host, '^www[.]', ''), CASE scheme WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '^$' END, '') || CASE WHEN path = '' THEN '/' ELSE path END
  || CASE WHEN query = '' THEN '' ELSE '?' || query END IN ({_LISTED}) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON p.r = hit.r AND k = 1
"""
