"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import cut


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """Connected components of an edge table: rows (node, root), root the least node of the component.

    Large-star and small-star rounds in turn, each checkpointed; their number is logarithmic in the
    size of the largest component.
    """
    links = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        both = links.union(links.select("b", "a")).toDF("n", "m")
        low = F.least(F.col("n"), F.min("m").over(Window.partitionBy("n")))
        large = both.withColumn("low", low).where("m > n").select(F.col("m").alias("n"), F.col("low").alias("m")).distinct()
        small = large.withColumn("low", F.min("m").over(Window.partitionBy("n")))
        links = cut(small.select("n", "low").union(small.where("m <> low").select("m", "low")).toDF("a", "b").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
