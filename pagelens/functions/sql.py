"""Functions for SQL: register(spark) makes extract_markdown, chunk_markdown and hash_embed known by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    @F.pandas_udf("string")
    def extract_markdown(html: pd.Series) -> pd.Series:
        from pagelens.operators.extract import extract

        return html.map(lambda h: extract(h)["markdown"])

    @F.pandas_udf("array<struct<text:string,embed_text:string,heading_path:array<string>,depth:int,words:int,index:int>>")
    def chunk_markdown(markdown: pd.Series) -> pd.Series:
        from pagelens.operators.chunks import chunk

        return markdown.map(lambda m: chunk(m or ""))

    @F.pandas_udf("array<double>")
    def hash_embed(text: pd.Series) -> pd.Series:
        from pagelens.operators.extract import embed

        return text.map(lambda t: embed(t or "").tolist())

    spark.udf.register("extract_markdown", extract_markdown)
    spark.udf.register("chunk_markdown", chunk_markdown)
    spark.udf.register("hash_embed", hash_embed)
