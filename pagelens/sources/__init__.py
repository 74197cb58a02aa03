"""Sources and sinks: HTML folders, Markdown, chunk lines, batch summaries. All go through Spark's readers and writers."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _by_charset(raw: bytes | None, name: str | None) -> str | None:
    """Bytes in the charset that a page names, if there is one of that name; else, and for Latin-1's names, in Windows-1252 as browsers do."""
    if raw is None:
        return None
    alias = {"iso-8859-1": "cp1252", "latin1": "cp1252", "latin-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "shift_jis": "cp932", "shift-jis": "cp932", "x-sjis": "cp932", "iso-8859-9": "cp1254", "ks_c_5601-1987": "cp949", "euc-kr": "cp949"}
    name = (name or "").strip().lower()
    try:
        return raw.decode(codecs.lookup(alias.get(name, name or "cp1252")).name, "replace")
    except (LookupError, ValueError):
        return raw.decode("cp1252", "replace")


def decode_bytes(raw: bytes) -> str:
    """decode() for one file in one process."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.removeprefix(codecs.BOM_UTF8).decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        found = re.search(rb"""(?i)<meta[^>]*charset=["']?([A-Za-z0-9_\-]+)""", raw[:2000])
        return _by_charset(raw, found and found[1].decode())


@F.pandas_udf(StringType())
def _charset_text(raw: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([_by_charset(r, n) for r, n in zip(raw, name)], dtype=object)


def decode(raw: Column) -> Column:
    """Text of fetched bytes: by byte-order mark, else UTF-8 where it is valid, else the charset that the head names, else Windows-1252.

    Only bytes that are not UTF-8 leave the JVM."""
    named = F.lower(F.regexp_extract(F.decode(F.substring(raw, 1, 2000), "ISO-8859-1"), r"""(?i)<meta[^>]*charset=["']?([A-Za-z0-9_\-]+)""", 1))
    mark, plain = F.hex(F.substring(raw, 1, 2)).isin("FEFF", "FFFE"), F.is_valid_utf8(raw.cast("string"))
    utf8 = named.isin("utf-8", "utf8")
    other = _charset_text(F.when(~mark & ~plain & ~utf8, raw), named)
    return (
        F.when(F.hex(F.substring(raw, 1, 3)) == "EFBBBF", F.make_valid_utf8(F.substring(raw, 4, 2_000_000_000).cast("string")))
        .when(mark, F.decode(raw, "UTF-16"))
        .when(plain, raw.cast("string"))
        .when(utf8, F.make_valid_utf8(raw.cast("string")))
        .otherwise(other)
    )


def read_html_dir(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of a folder of <id>.html files, with the url of <id>.meta.json where there is one; names that start with _ are skipped."""
    stem = lambda suffix: F.regexp_extract("path", rf"([^/]+){suffix}$", 1)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select(stem(r"\.html").alias("page_id"), decode(F.col("content")).alias("html"))
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").load(path)
    meta = meta.select(stem(r"\.meta\.json").alias("page_id"), F.get_json_object(F.decode("content", "UTF-8"), "$.url").alias("url"))
    return raw.filter(~F.col("page_id").startswith("_")).join(meta, "page_id", "left").select("page_id", "url", "html")


def read_questions(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """(interaction_id, query, answer, split, page_url, page_result): questions in JSON lines (plain or .bz2), of one split or all, one
    row for each search result."""
    schema = "interaction_id string, query string, answer string, alt_ans array<string>, split int, domain string, search_results array<struct<page_url:string,page_result:string>>"
    q = spark.read.schema(schema).json(path)
    q = q if split is None else q.filter(F.col("split") == split)
    return q.select("interaction_id", "query", "answer", "alt_ans", "split", "domain", F.explode_outer("search_results").alias("r")).select("*", "r.page_url", "r.page_result").drop("r")


def documents(extracted: DataFrame) -> DataFrame:
    """(page_content, metadata) for document loaders: the body without front matter, and flat metadata."""
    body = F.regexp_replace("markdown", r"(?s)\A---\n.*?\n---\n+", "")
    flat = F.transform_values(F.from_json("front_matter", "map<string,string>"), lambda k, v: F.coalesce(F.array_join(F.from_json(v, "array<string>"), " > "), v))
    return extracted.select(body.alias("page_content"), F.map_concat(flat, F.create_map(F.lit("page_id"), F.col("page_id").cast("string"))).alias("metadata"))


def write_markdown(extracted: DataFrame, path: str) -> None:
    """Markdown by page, in Parquet laid out for lookups by page."""
    extracted.select("page_id", "url", "markdown").write.mode("overwrite").parquet(path)


def write_markdown_files(extracted: DataFrame, path: str) -> None:
    """One Markdown file for each page, <path>/page=<id>/part-*.txt, written by the executors."""
    rows = extracted.select(F.col("page_id").cast("string").alias("page"), F.coalesce("markdown", F.lit("")).alias("value"))
    rows.write.mode("overwrite").partitionBy("page").text(path)


def write_chunks(extracted: DataFrame, path: str) -> None:
    """One JSON object for each chunk, with its page's url."""
    extracted.select("page_id", "url", F.explode("chunks").alias("c")).select("page_id", "url", "c.*").write.mode("overwrite").json(path)


def summary(extracted: DataFrame) -> DataFrame:
    """One row for each page: what a batch run reports."""
    return extracted.select("page_id", "url", "tokens", "root", "n_blocks", "n_kept", "warnings", F.size("chunks").alias("n_chunks"))
