"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialise import ensure_checkpoint_dir
from ..sources.io import read_table

WORD = r"[^ \t\r\n]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return read_table(spark, sf_dir, table)


def keep(df: DataFrame) -> DataFrame:
    """Write a wide or large table into the shared checkpoint folder as Parquet, and read it back."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Internal column names that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name = f"__{base}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        names.append(name)
    return names


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[str], weights: dict[str, str]) -> DataFrame:
    """Add columns ``weights`` (name -> weight): sums of the weight over the rows of the same keys that come earlier in (bucket, *order).

    A key's rows are spread over its buckets, so that a hot key is not one task: bucket totals
    (a small table) give each bucket's offset, and a window runs inside a bucket only.
    The frame is read twice and should be materialised.
    """
    each = df.groupBy(*keys, bucket).agg(*[F.sum(w).alias(f"__w_{n}") for n, w in weights.items()])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        *[F.col(k).alias(f"__o_{k}") for k in keys],
        F.col(bucket).alias("__o_bucket"),
        *[F.coalesce(F.sum(f"__w_{n}").over(earlier), F.lit(0)).alias(f"__off_{n}") for n in weights],
    )
    on = F.col(bucket) == F.col("__o_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.select("*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(n) for n, w in weights.items()])
    return ranked.join(offsets, on).select(*df.columns, *[(F.col(n) + F.col(f"__off_{n}")).alias(n) for n in weights])


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))


class Powers:
    """Powers of the polynomial base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            m = max(n, 1 << 20)
            for name, base in (("up", _P), ("down", _PINV)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefixes(hashes: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes of a sequence of word hashes."""
    up, _ = POWERS.upto(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=out[1:])
    return out


_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD_BYTES[_c] = True
_SOLID_BYTES = np.ones(256, bool)
_SOLID_BYTES[[9, 10, 13, 32]] = False


def chunks(texts: list, limit: int = 1 << 20):
    """Runs (start, stop) of texts of about ``limit`` characters together; a longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def spans(data: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of byte strings: (buffer, start, end, index of the string)."""
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    solid = table[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid)).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in data), np.int64, len(data)))
    return buf, start, end, np.searchsorted(ends, start, "right")


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte spans, by prefix sums, then mixed."""
    up, down = POWERS.upto(len(buf) + 1)
    prefix = np.empty(len(buf) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (letters, digits, any non-ASCII) of texts, and each word's text."""
    data = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    buf, start, end, of = spans(data, _WORD_BYTES)
    return hash_spans(buf, start, end), of
