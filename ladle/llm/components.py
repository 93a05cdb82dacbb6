"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.session import ensure_checkpoint_dir


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for each node of the links (u, v); root is the smallest node of its component.

    Each round is joins and aggregations over the links; lineage is cut by checkpoint().
    """
    ensure_checkpoint_dir(links.sparkSession)
    stars = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        pairs = _both(stars)
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pairs.join(low, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        stars = small.checkpoint()
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
