"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """Add ``name``: the rank from 1 of each row among those of equal keys, by (bucket, *order).

    A group's rows are spread over its buckets, so that a large one is not one task: the sizes of buckets, a small
    table, give each one's offset, and a window runs inside a bucket only. Null keys are equal.
    """
    marked = df.withColumn("__b", bucket)
    at = F.desc("__b") if descending else F.asc("__b")
    earlier = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    offsets = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    on = F.col("__b").eqNullSafe(F.col("__ob"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order))
    return marked.withColumn("__r", inside).join(offsets, on).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__r") + F.col("__off")).alias(name))
