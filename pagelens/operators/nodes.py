"""The node table, and statistics of subtrees by windows over it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..html import Page

SCHEMA = "page_id long, nid int, end int, parent int, depth int, tag string, html_id string, classes array<string>, role string, attrs map<string,string>, text string"


PART = 4_000_000  # bytes of files, as stored, whose pages are one task's work: about 3,000 of the driver's pages


def dealt(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows, made from pages, in partitions by the size of what pages reads, so that a task's work does not grow with the table; and in a few
    for each core where the table is small. An input whose size Spark does not know keeps its partitions if there is one for each core."""
    n, parts = pages.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    size = int(pages._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    wanted = max(4 * n if parts < n else 0, -(-size // PART) if size < 2**60 else 0)
    return rows.repartition(wanted) if wanted > parts else rows


def nodes(pages: DataFrame) -> DataFrame:
    """One row for each element and text node, numbered in document order; tag is empty for text, end the last number below a node."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                p = Page(r["html"])
                rows = [{"page_id": r["page_id"], "nid": i, "end": int(p.end[i]), "parent": p.parent[i], "depth": p.depth[i], "tag": p.tag[i], "html_id": p.attrs[i].get("id"), "classes": p.classes(i), "role": p.role(i), "attrs": list(p.attrs[i].items()), "text": p.text[i]} for i in range(len(p))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return dealt(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), pages).mapInArrow(run, SCHEMA)


def without(table: DataFrame, marked) -> DataFrame:
    """Nodes outside the subtrees of marked ones: one running maximum of the marked ends, and no recursion."""
    w = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumn("_cut", F.max(F.when(marked, F.col("end"))).over(w)).filter("_cut is null or _cut < nid").drop("_cut")


def text_lengths(table: DataFrame) -> DataFrame:
    """(page_id, nid, tag, text_len) of elements: stripped texts below each, joined by one blank, as differences of running sums."""
    w = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(F.col("tag") == "", F.length(F.regexp_replace(F.col("text"), r"^\s+|\s+$", ""))).otherwise(0)
    sums = table.withColumn("size", size).withColumn("s", F.sum("size").over(w)).withColumn("c", F.sum((F.col("size") > 0).cast("int")).over(w))
    last = sums.select("page_id", F.col("nid").alias("end"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    out = sums.filter("tag <> ''").join(last, ["page_id", "end"])
    return out.select("page_id", "nid", "tag", (F.col("s2") - F.col("s") + F.greatest(F.lit(0), F.col("c2") - F.col("c") - 1)).cast("long").alias("text_len"))
