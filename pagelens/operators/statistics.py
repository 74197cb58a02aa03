"""Samples, intervals and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, n: Column) -> Column:
    """0 .. n-1 from the first 8 hex digits of the key's md5: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n)


def site_bootstrap(scores: DataFrame, site: str, value: str, draws: int = 200, seed: int = 7) -> DataFrame:
    """One row: the mean over pages, and the 2.5 and 97.5 percentiles (sorted index) of means over resampled sites."""
    sites = scores.groupBy(site).agg(F.count("*").alias("n"), F.sum(value).alias("s")).withColumn("i", F.row_number().over(Window.orderBy(site)) - 1)
    n = sites.count()
    picks = sites.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    picks = picks.withColumn("i", draw(F.concat_ws("-", F.lit(seed), "draw", "j"), F.lit(max(1, n))))
    means = picks.join(sites, "i").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(Window.orderBy("m")) - 1)  # one row for each draw
    low, high = int(0.025 * draws), min(draws - 1, int(0.975 * draws))
    ci = ranked.agg(F.round(F.max(F.when(F.col("r") == low, F.col("m"))), 6).alias("low"), F.round(F.max(F.when(F.col("r") == high, F.col("m"))), 6).alias("high"))
    return scores.agg(F.round(F.sum(value) / F.count("*"), 6).alias("mean")).crossJoin(ci)  # one row each


def stratified(rows: DataFrame, stratum: str, id: str, size: int, seed: int = 7) -> DataFrame:
    """(stratum, id) of about `size` rows: quotas in proportion by largest remainder, then the rows whose md5 comes first."""
    per = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 1
    exact = F.col("n") * size / F.lit(float(total))
    base = per.withColumn("q", F.floor(exact).cast("long")).withColumn("rest", exact - F.floor(exact))
    short = size - (base.agg(F.sum("q")).first()[0] or 0)
    quota = base.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), stratum))).withColumn("q", F.col("q") + (F.col("k") <= short).cast("long"))
    return _first(rows.select(stratum, id).join(quota.select(stratum, "q"), stratum), stratum, id, F.col("q"), seed).select(stratum, id)


def _first(rows: DataFrame, group: str, id: str, most: Column, seed: int, parts: int = 64) -> DataFrame:
    """The rows of each group whose md5 comes first, `most` of them: of 64 parts of a group first, then of what these leave, so that no
    task ranks all of a large group."""
    keyed = rows.withColumn("_key", F.md5(F.concat_ws("-", F.lit(seed), F.col(id)))).withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(parts)))
    near = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", id))).filter(F.col("_r") <= most)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_key", id))).filter(F.col("_r") <= most).drop("_key", "_part", "_r")


def capped(rows: DataFrame, group: str, id: str, most: int, seed: int = 7) -> DataFrame:
    """(group, id) of up to `most` rows of each group, by md5 order."""
    return _first(rows.select(group, id), group, id, F.lit(most), seed).select(group, id)


def krippendorff(votes: DataFrame, unit: str, rater: str, value: str) -> DataFrame:
    """One row: nominal alpha over units with two votes or more."""
    m = votes.groupBy(unit).agg(F.count("*").alias("m")).filter("m > 1")
    v = votes.join(m, unit).groupBy(unit, value, "m").agg(F.count("*").alias("c"))
    agree = v.agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("same"), F.sum("c").alias("n"))
    margin = v.groupBy(value).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("tt"))
    observed = 1 - F.col("same") / F.col("n")
    expected = 1 - F.col("tt") / (F.col("n") * (F.col("n") - 1))
    return agree.crossJoin(margin).select(F.round(1 - observed / expected, 6).alias("alpha"))  # one row each


def cohen(votes: DataFrame, unit: str, rater: str, value: str, a: str, b: str) -> DataFrame:
    """One row: kappa of two raters over the units that both judged."""
    x = votes.filter(F.col(rater) == a).select(unit, F.col(value).alias("va"))
    y = votes.filter(F.col(rater) == b).select(unit, F.col(value).alias("vb"))
    both = x.join(y, unit)
    n = both.agg(F.count("*").alias("n"), F.sum((F.col("va") == F.col("vb")).cast("int")).alias("same"))
    pa, pb = both.groupBy("va").agg(F.count("*").alias("ca")), both.groupBy("vb").agg(F.count("*").alias("cb"))
    chance = pa.join(pb, pa.va == pb.vb).agg(F.coalesce(F.sum(F.col("ca") * F.col("cb")), F.lit(0)).alias("e"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).select(F.round((po - pe) / (1 - pe), 6).alias("kappa"))  # one row each


def majority(votes: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, verdict): the unique most frequent value, else tie."""
    c = votes.groupBy(unit, value).agg(F.count("*").alias("c"))
    top = c.groupBy(unit).agg(F.max("c").alias("top"))
    return c.join(top, unit).filter("c = top").groupBy(unit).agg(F.when(F.count("*") == 1, F.max(value)).otherwise(F.lit("tie")).alias("verdict"))


def length_bands(pairs: DataFrame, ours: str, theirs: str, winner: str, band: float = 1.1) -> DataFrame:
    """(band, n, wins, losses, ties, net) of all pairs, and by the ratio of lengths: similar within `band`, else longer or shorter."""
    ratio = (F.col(ours) + 1) / (F.col(theirs) + 1)
    place = F.when(ratio > band, "longer").when(ratio < 1 / band, "shorter").otherwise("similar")
    won, lost = F.sum((F.col(winner) == "ours").cast("long")), F.sum((F.col(winner) == "theirs").cast("long"))
    rows = pairs.select(winner, F.explode(F.array(F.lit("all"), place)).alias("band"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), won.alias("wins"), lost.alias("losses"), (F.count("*") - won - lost).alias("ties"), F.round((won - lost) / F.count("*"), 3).alias("net"))


def equal_length_lead(pairs: DataFrame, ours: str, theirs: str, winner: str) -> float | None:
    """The chance to win at equal length: the intercept of a logistic fit of decided pairs on the logarithm of the ratio of lengths,
    fitted by Spark over all of them. None without a decided pair, or where all were decided alike."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    x = F.log((F.col(ours) + 1) / (F.col(theirs) + 1))
    rows = pairs.filter(F.col(winner).isin("ours", "theirs")).select(x.alias("x"), (F.col(winner) == "ours").cast("double").alias("y"))
    if len(rows.select("y").distinct().take(2)) < 2:
        return None
    fit = LogisticRegression(featuresCol="v", labelCol="y", maxIter=100, tol=1e-10, standardization=False).fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(rows))
    import math

    return 1 / (1 + math.exp(-fit.intercept))
