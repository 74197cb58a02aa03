"""Blocks of a page, what surrounds them, and what a scored block list keeps: windows over the node table and over block tables.

A block table has page_id, idx (0, 1, ... in document order), tag and text; a scored one has p, a box's number and whether a block is
the page's title. A page's blocks are the unit of every window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags that are blocks, that can be, that make an outer element none, and ancestors that are told.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVES = ("p", *HEADINGS, "li", "pre", "blockquote", "figcaption", "dt", "dd", "table")
CONTAINERS = ("div", "section", "article", "span")
NESTED = ("div", "section", "article", "p", "ul", "ol", "li", "table", "pre", "blockquote", "dl", "form", *HEADINGS)
ANCESTORS = ("main", "article", "header", "footer", "aside", "form", "ul", "ol", "blockquote", "section", "nav", "a", "label")
CLASS_BUCKETS, LEAST_BLOCKS, LEAST_REPEAT = 192, 4, 30
HEADING_RESCUE, LEAD_RESCUE, LEAD_WORDS = 0.08, 0.10, 8
LONG_TABLE, PAIR_DISTANCE, GRID_TERMS, GRID_TERM, GRID_DEFINITION = 500, 2, 4, 40, 80


def _page(order: str = "idx"):
    return Window.partitionBy("page_id").orderBy(order)


def find_blocks(nodes: DataFrame) -> DataFrame:
    """(page_id, idx, nid, end, tag, text, classes, in_<tag> ...): leaves, and containers of 20 characters without a block inside; an
    item with items inside and a paragraph around a table are none; nothing inside a block is one.

    Whether a subtree holds a tag is a difference of two running counts, and whether a node lies in a marked one a running maximum."""
    up_to = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1)
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    n = nodes.withColumn("bare", F.when(F.col("tag") == "", bare).otherwise(""))
    counted = {"blocks": F.col("tag").isin(*NESTED), "items": F.col("tag") == "li", "tables": F.col("tag") == "table", "chars": F.length("bare"), "pieces": F.length("bare") > 0}
    n = n.select("page_id", "nid", "end", "tag", "classes", "bare", *[F.sum(c.cast("int")).over(up_to).alias(f"s_{k}") for k, c in counted.items()], *[(F.max(F.when(F.col("tag") == t, F.col("end"))).over(before) >= F.col("nid")).alias(f"in_{t}") for t in ANCESTORS])
    last = n.select("page_id", F.col("nid").alias("end"), *[F.col(f"s_{k}").alias(f"e_{k}") for k in counted])
    el = n.filter("tag <> ''").join(last, ["page_id", "end"])
    held = {k: F.col(f"e_{k}") - F.col(f"s_{k}") for k in counted}
    leaf = F.col("tag").isin(*LEAVES) & ~((F.col("tag") == "li") & (held["items"] > 0)) & ~(F.col("tag").isin("p", "blockquote", "li") & (held["tables"] > 0))
    wide = F.col("tag").isin(*CONTAINERS) & (held["chars"] + F.greatest(F.lit(0), held["pieces"] - 1) >= 20) & (held["blocks"] == 0)
    flags = [F.coalesce(f"in_{t}", F.lit(False)).alias(f"in_{t}") for t in ANCESTORS]
    able = el.filter(leaf | wide).select("page_id", "nid", "end", "tag", "classes", *flags)
    inside = F.max("end").over(Window.partitionBy("page_id").orderBy("nid").rowsBetween(Window.unboundedPreceding, -1))
    taken = able.withColumn("inside", inside).filter("inside is null or inside < nid").drop("inside")
    words = n.filter("bare <> ''").select("page_id", F.col("nid").alias("at"), "bare")
    marks = taken.select("page_id", F.col("nid").alias("at"), "nid", "end").unionByName(words, allowMissingColumns=True)
    own = marks.select("page_id", "at", "bare", F.last(F.when(F.col("nid").isNotNull(), F.struct("nid", "end")), True).over(Window.partitionBy("page_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("block"))
    texts = own.filter("bare is not null and at <= block.end").groupBy("page_id", F.col("block.nid").alias("nid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bare"))), lambda x: x["bare"]), " ").alias("text"))
    return taken.join(texts, ["page_id", "nid"]).withColumn("idx", F.row_number().over(_page("nid")) - 1)


def facts(blocks: DataFrame) -> DataFrame:
    """blocks with what the operators below ask of a text: its characters, words, and a hash and the characters of it in one case and spacing.
    Where they are there already, `text` itself need not go through windows."""
    key = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return blocks.withColumns({"_chars": F.length("text"), "_words": words, "_key": F.xxhash64(key), "_key_chars": F.length(key)})


FACTS = ("_chars", "_words", "_key", "_key_chars")


def _with_facts(blocks: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """blocks with their facts, and those that are to be dropped again."""
    return (blocks, ()) if "_chars" in blocks.columns else (facts(blocks), FACTS)


def surroundings(blocks: DataFrame) -> DataFrame:
    """blocks with their place (share of the page, characters before and after, distance to the last heading), neighbours' characters and
    repeats: how many blocks of the page have the same text (ten at most), and whether one stands before."""
    w, page = _page(), Window.partitionBy("page_id")
    blocks, extra = _with_facts(blocks)
    chars = F.col("_chars")
    same = Window.partitionBy("page_id", "_key", "_key_chars")
    heading = F.last(F.when(F.col("tag").isin(*HEADINGS), F.col("idx")), True).over(w)
    return blocks.select(
        "*",
        F.round(F.col("idx") / F.greatest(F.lit(1), F.count("*").over(page) - 1), 6).alias("place"),
        (F.sum(chars).over(w) - chars).cast("long").alias("chars_before"),
        (F.sum(chars).over(page) - F.sum(chars).over(w)).cast("long").alias("chars_after"),
        (F.col("idx") - heading).cast("long").alias("since_heading"),
        F.lag(chars).over(w).cast("long").alias("chars_prev"),
        F.lead(chars).over(w).cast("long").alias("chars_next"),
        F.least(F.lit(10), F.count("*").over(same)).cast("long").alias("repeats"),
        (F.row_number().over(same.orderBy("idx")) > 1).alias("seen_earlier"),
    ).drop(*extra)


def hashed(words: Column, n: int = CLASS_BUCKETS) -> Column:
    """The buckets of n that an array of words falls into, by CRC-32, each once and in order."""
    return F.array_sort(F.array_distinct(F.transform(words, lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(n)).cast("int"))))


def stack(scored: DataFrame) -> DataFrame:
    """scored with the thirteen numbers that a second stage sees: scores of the blocks around (0.5 beyond the ends), a box's mean weighted
    by characters, least, most and size, the page's mean, the score's rank, and the means of the boxes before and after."""
    w, box, page = _page(), Window.partitionBy("page_id", "box"), Window.partitionBy("page_id")
    down = Window.partitionBy("page_id").orderBy(F.desc("idx"))
    weight = F.greatest(F.lit(1.0), F.length("text").cast("double"))
    near = lambda k: F.coalesce(F.lag("p", k).over(w) if k > 0 else F.lead("p", -k).over(w), F.lit(0.5))
    alone = F.col("box") < 0
    own = lambda c: F.when(alone, F.col("p")).otherwise(c)
    out = scored.select(
        "*", near(1).alias("p_prev"), near(-1).alias("p_next"), near(2).alias("p_prev2"), near(-2).alias("p_next2"),
        own(F.sum(F.col("p") * weight).over(box) / F.sum(weight).over(box)).alias("box_mean"), own(F.min("p").over(box)).alias("box_min"), own(F.max("p").over(box)).alias("box_max"),
        F.when(alone, F.lit(1)).otherwise(F.count("*").over(box)).cast("long").alias("box_n"), (F.sum(F.col("p") * weight).over(page) / F.sum(weight).over(page)).alias("page_mean"),
        ((F.row_number().over(Window.partitionBy("page_id").orderBy("p", "idx")) - 0.5) / F.count("*").over(page)).alias("p_rank"),
    )
    turn = lambda order: F.when(F.lag("box").over(order) != F.col("box"), F.lag("box_mean").over(order))
    out = out.withColumn("_a", turn(w)).withColumn("_b", turn(down))
    return out.select("*", F.coalesce(F.last("_a", True).over(w), F.lit(0.5)).alias("box_before"), F.coalesce(F.last("_b", True).over(down), F.lit(0.5)).alias("box_after")).drop("_a", "_b")


def keep(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scored with `base` and `keep`: pages of fewer than four blocks stay whole; a block stays by its score, unless its text of 30
    characters or more has been kept before; the title stays. A heading of some score stays before a block that did, within the next two,
    and so does a text of eight words right after the title."""
    w = _page()
    scored, extra = _with_facts(scored)
    rows = scored.withColumn("_pass", F.col("is_title") | (F.col("p") >= threshold))
    nth = F.sum(F.col("_pass").cast("int")).over(Window.partitionBy("page_id", "_key", "_key_chars").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    again = (F.col("_key_chars") >= LEAST_REPEAT) & (F.coalesce(nth, F.lit(0)) > 0)
    few = F.count("*").over(Window.partitionBy("page_id")) < LEAST_BLOCKS
    rows = rows.withColumn("base", few | F.col("is_title") | F.col("_pass") & ~again)
    soon = F.coalesce(F.lead("base", 1).over(w), F.lit(False)) | F.coalesce(F.lead("base", 2).over(w), F.lit(False))
    heading = F.col("tag").isin(*HEADINGS) & (F.col("p") >= HEADING_RESCUE) & (F.col("p") < threshold) & soon
    lead = F.coalesce(F.lag("is_title").over(w), F.lit(False)) & F.col("tag").isin("p", "div") & (F.col("_words") >= LEAD_WORDS) & (F.col("p") >= LEAD_RESCUE)
    return rows.withColumn("keep", F.col("base") | heading | lead).drop("_pass", *extra)


def rescue(kept: DataFrame, threshold: float = 0.5) -> DataFrame:
    """kept with `keep` widened by data tables and terms that stand in a kept section; decided on `keep` as it comes in, so none leads to another.

    Columns beyond those of keep(): is_data and n_rows of a table, list_id (the definition list of a dt or dd, else null) and list_marked
    (its names say furniture). A section is what follows a heading up to the next. A data table stays under a kept heading, or with 500 rows
    anywhere; within two blocks of a heading of some score both stay. A text of 30 characters that is kept already is not kept again. Terms
    and definitions stay under a kept heading, but for lists of four short terms or more with short definitions, as products have.
    """
    w, page = _page(), Window.partitionBy("page_id")
    own = Window.partitionBy("page_id", "list_id")
    is_heading = F.col("tag").isin(*HEADINGS)
    head = F.last(F.when(is_heading, F.struct("idx", "keep", "p")), True).over(w)
    kept, extra = _with_facts(kept)
    rows = kept.withColumn("_h", head)
    same = Window.partitionBy("page_id", "_key", "_key_chars")
    long = F.col("_key_chars") >= LEAST_REPEAT
    there = long & F.max(F.when(F.col("_chars") >= LEAST_REPEAT, F.col("keep")).otherwise(False)).over(same)
    free = ~F.col("keep") & (F.col("tag") == "table") & F.coalesce("is_data", F.lit(False)) & ~there
    under, near = F.col("_h.keep"), (F.col("_h.p") >= HEADING_RESCUE) & (F.col("_h.p") < threshold) & (F.col("idx") - F.col("_h.idx") <= PAIR_DISTANCE)
    big = F.coalesce(F.col("n_rows") >= LONG_TABLE, F.lit(False))
    rows = rows.withColumn("_able", free & (big | F.coalesce(under | near, F.lit(False))))
    first = F.row_number().over(Window.partitionBy("page_id", "_key", "_key_chars", F.col("_able") & ~big).orderBy("idx")) == 1
    rows = rows.withColumn("_table", F.col("_able") & (big | first | ~long))
    pair = F.when(F.col("_table") & ~big & ~under, F.col("_h.idx"))
    rows = rows.withColumn("_heads", F.collect_set(pair).over(page))
    longest = lambda tag: F.max(F.when(F.col("tag") == tag, F.col("_chars"))).over(own)
    grid = (F.sum((F.col("tag") == "dt").cast("int")).over(own) >= GRID_TERMS) & (longest("dt") <= GRID_TERM) & (longest("dd") <= GRID_DEFINITION)
    term = F.col("tag").isin("dt", "dd") & F.col("list_id").isNotNull() & ~F.coalesce("list_marked", F.lit(False)) & ~F.coalesce(grid, F.lit(False)) & F.coalesce(under, F.lit(False))
    rows = rows.withColumn("keep", F.col("keep") | F.col("_table") | is_heading & F.array_contains("_heads", F.col("idx")) | term)
    return rows.drop("_h", "_able", "_table", "_heads", *extra)


def expected(kept: DataFrame, least: float = 0.70) -> DataFrame:
    """(page_id, n_blocks, n_kept, precision, recall, f1, unsure): what a page's own scores say about what is kept, by words."""
    words = F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")))
    sums = kept.groupBy("page_id").agg(F.count("*").alias("n_blocks"), F.sum(F.col("keep").cast("int")).cast("long").alias("n_kept"), F.sum(F.when(F.col("keep"), words * F.col("p")).otherwise(0.0)).alias("tp"), F.sum(words * F.col("p")).alias("ref"), F.sum(F.when(F.col("keep"), words).otherwise(0)).alias("out"))
    p, r = F.col("tp") / F.greatest(F.lit(1.0), F.col("out").cast("double")), F.col("tp") / F.greatest(F.lit(1.0), F.col("ref"))
    out = sums.withColumn("p", p).withColumn("r", r).withColumn("f", 2 * p * r / F.greatest(p + r, F.lit(1e-9)))
    return out.select("page_id", "n_blocks", "n_kept", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"), (F.round("f", 6) < least).alias("unsure"))


def dual_regions(scored: DataFrame, least: float = 0.42, words: int = 25) -> DataFrame:
    """(page_id, n_regions, dual): boxes whose mean score and words say content; two of them make a page one with two regions."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    boxes = scored.filter("box >= 0").groupBy("page_id", "box").agg(F.avg("p").alias("p"), F.sum(n).alias("n"))
    hit = boxes.withColumn("hit", (F.round("p", 9) >= least) & (F.col("n") >= words))
    return hit.groupBy("page_id").agg(F.sum(F.col("hit").cast("int")).cast("long").alias("n_regions")).withColumn("dual", F.col("n_regions") >= 2)


def train(features: DataFrame, columns: list[str], label: str = "label", *, rounds: int = 50, depth: int = 5, step: float = 0.1, seed: int = 7):
    """Boosted trees over feature columns, trained by Spark on all rows; score() applies them."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(features)
    return GBTClassifier(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed).fit(rows)


def score(model, features: DataFrame, columns: list[str]) -> DataFrame:
    """features with p, the probability that a block is content."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(features)
    out = model.transform(rows)
    return out.withColumn("p", vector_to_array("probability")[1]).select(*features.columns, "p")
