"""Exact nearest neighbours by a block matrix join with int8 tiles.

The queries are the vectors whose id is divisible by ``every`` (1: all); they are searched in all
vectors. Both are dealt to blocks by a hash of their id, and blocks are taken together in stripes
on either side. A task has one stripe of queries and one of vectors, which it reads block by block:
an int8 product tile gives all inner products at once (the codes are multiplied as float32, which
is exact for sums below 2**24), and the norms of both vectors' quantisation errors bound each
distance from both sides. Pairs whose lower bound is above the query's k-th best distance so far
are pruned; the others are recomputed from the vectors in double precision and merged into the
query's heap of k. The heaps of a query's stripes are merged at the end. As the bounds are strict,
the result is exact.

Work is queries times vectors, as in any exact search. A vector is sent once to each stripe of
queries, a query once to each stripe of vectors: copies grow with blocks / stripe on either side.
A task holds a stripe of queries and one block of vectors, and no side is broadcast.

Defined cases: a null id, a null vector, and a vector with null, NaN or infinite elements or with
another length than most (the least such length on a tie) is left out; a table without any query has no
result; rows of one id are one vector, the least of them; equal distances are ranked by id; with fewer than k others, all are
listed; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import cut

K = 10
#: The registered search: the queries are the ids divisible by it.
EVERY = 20
BLOCK_ROWS = 4096
#: Blocks of queries, and of vectors, that a task takes.
QUERY_STRIPE = 4
STRIPE = 32
STRIP = 512


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector, and norm of the error, of each row."""
    scale = np.abs(x).max(axis=1) / 127 if x.shape[1] else np.zeros(len(x))
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x - coded, axis=1) + 1e-12 * np.linalg.norm(x, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer products of int8 rows, by float32 slices whose sums stay below 2**24."""
    step = (1 << 24) // (127 * 127)
    out = a[:, :step].astype(np.float32) @ b[:, :step].astype(np.float32).T
    for at in range(step, a.shape[1], step):
        out = out.astype(np.float64) + a[:, at : at + step].astype(np.float32) @ b[:, at : at + step].astype(np.float32).T
    return out


class Heaps:
    """The k nearest so far of each query of a block: distances (squared) and ids, by (distance, id)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.codes, self.scale, self.coded, self.error = quantise(x)
        self.square = (x * x).sum(axis=1)
        self.best = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Merge a block into the heaps, a strip of queries at a time so that a tile's matrices stay small."""
        block = (ids, x, *quantise(x), (x * x).sum(axis=1))
        for at in range(0, len(self.ids), STRIP):
            self._strip(slice(at, at + STRIP), *block)

    def _strip(self, own: slice, ids, x, codes, scale, coded, error, square) -> None:
        approx = products(self.codes[own], codes) * (self.scale[own, None] * scale)
        # |x.y - approx| <= |x'||e_y| + |e_x||y'| + |e_x||e_y|
        bound = self.coded[own, None] * error + self.error[own, None] * (coded + error)
        squares = self.square[own, None] + square
        middle = squares - 2 * approx
        bound = 2 * bound + 1e-9 * squares + 1e-300
        kth = self.best[own, -1]
        same = self.ids[own, None] == ids
        if np.isinf(kth).any() and len(ids) > self.k:
            upper = np.where(same, np.inf, middle + bound)
            kth = np.minimum(kth, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero((middle - bound <= kth[:, None]) & ~same)
        if not len(q):
            return
        q += own.start
        exact = np.empty(len(q))
        for at in range(0, len(q), 1 << 16):
            d = self.x[q[at : at + (1 << 16)]] - x[c[at : at + (1 << 16)]]
            exact[at : at + (1 << 16)] = np.einsum("ij,ij->i", d, d)
        touched = np.unique(q)
        owner = np.concatenate([np.repeat(touched, self.k), q])
        dist = np.concatenate([self.best[touched].ravel(), exact])
        ident = np.concatenate([self.near[touched].ravel(), ids[c]])
        order = np.lexsort((ident, dist, owner))
        owner, dist, ident = owner[order], dist[order], ident[order]
        starts = np.searchsorted(owner, touched)
        take = starts[:, None] + np.arange(self.k)
        self.best[touched], self.near[touched] = dist[take], ident[take]

    def rows(self) -> pa.RecordBatch:
        q, r = np.nonzero(np.isfinite(self.best))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.near[q, r]), pa.array(self.best[q, r])], names=["vec_id", "neighbor_id", "d2"])


def _tiles(k: int):
    """Rows (task, role, block, id, x), sorted so: a task's queries (role 0), then its stripe (role 1) block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, queries, current, part, task = None, [], [], None, None

        def flush() -> None:
            nonlocal current
            if heaps is not None and current:
                heaps.offer(*_stacked(current))
            current = []

        for b in batches:
            t, role, block = (b.column(i).to_numpy() for i in range(3))
            if not len(t):
                continue
            edges = np.flatnonzero((np.diff(t) != 0) | (np.diff(role) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(t)]):
                piece = b.slice(lo, hi - lo)
                if t[lo] != task:
                    flush()
                    if heaps is not None:
                        yield heaps.rows()
                    heaps, queries, part, task = None, [], None, t[lo]
                if role[lo] == 0:
                    queries.append(piece)
                    continue
                if heaps is None:
                    heaps = Heaps(*_stacked(queries), k) if queries else None
                    queries = []
                if block[lo] != part:
                    flush()
                    part = block[lo]
                current.append(piece)
        flush()
        if heaps is not None:
            yield heaps.rows()

    return run


def _stacked(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([p.column(3).to_numpy() for p in parts])
    x = np.concatenate([np.frombuffer(b"".join(p.column(4).to_pylist()), np.float64).reshape(p.num_rows, -1) for p in parts])
    return ids, x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of their doubles."""
    for b in batches:
        col = b.column(1)
        values, offsets = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(np.array([len(x) for x in col], np.int64))))
        packed = [values[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array(np.diff(offsets).astype(np.int32))], names=["id", "x", "n"])


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1) -> tuple[DataFrame, int, int]:
    """Rows (id, x, n): one clean vector an id, as bytes of doubles, all of the commonest length n; how many, and how many are queries."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("x")).where("id is not null and x is not null").where(~bad)
    packed = cut(rows.groupBy("id").agg(F.min("x").alias("x")).mapInArrow(_pack, "id bigint, x binary, n int"))
    usual = packed.groupBy("n").agg(F.count("*").alias("rows"), F.count_if(F.col("id") % every == 0).alias("queries")).orderBy(F.desc("rows"), "n").first()
    return packed.where(F.col("n") == (usual["n"] if usual else 0)), usual["rows"] if usual else 0, usual["queries"] if usual else 0


def _grid(n: int, block_rows: int, stripe: int, least: int) -> tuple[int, int]:
    """(blocks, stripes) of n rows: whole stripes, at least ``least`` of them while there are as many blocks."""
    blocks = max(1, -(-n // block_rows))
    return blocks, max(-(-blocks // stripe), min(blocks, least))


def knn(
    table: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, stripe: int = STRIPE, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 1, query_stripe: int = QUERY_STRIPE
) -> DataFrame:
    """Rows (vec_id, rank, neighbor_id, distance): the k nearest others of every query, Euclidean, to six places."""
    clean, n, n_queries = vectors(table, id_col, vector_col, every)
    _, groups = _grid(n_queries, block_rows, query_stripe, 1)
    blocks, stripes = _grid(n, block_rows, stripe, -(-table.sparkSession.sparkContext.defaultParallelism // groups))
    code = F.xxhash64("id")
    group, block = F.pmod(code, F.lit(groups)), F.pmod(F.shiftrightunsigned(code, 20), F.lit(blocks))
    task = lambda g, s: (g * F.lit(stripes) + s).cast("int")
    queries = clean.where(F.col("id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("s"), group.alias("g"), "id", "x"
    ).select(task(F.col("g"), F.col("s")).alias("task"), F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("block"), "id", "x")
    others = clean.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), block.alias("block"), "id", "x").select(
        task(F.col("g"), F.col("block") % stripes).alias("task"), F.lit(1).alias("role"), "block", "id", "x"
    )
    # each task is a partition of its own, so that none gets two
    sent = queries.unionByName(others).repartitionById(groups * stripes, F.col("task")).sortWithinPartitions("task", "role", "block")
    found = sent.mapInArrow(_tiles(k), "vec_id bigint, neighbor_id bigint, d2 double")
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy("d2", "neighbor_id"))
    return found.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("vec_id", "rank", "neighbor_id", F.round(F.sqrt("d2"), 6).alias("distance"))


def knn_sql(k: int = K, every: int = EVERY) -> str:
    """DuckDB SQL of ``knn`` over the table embeddings."""
    return (
        "with v as (select vec_id, min(embedding::double[]) as x from embeddings where vec_id is not null and embedding is not null group by vec_id), "
        f"p as (select a.vec_id, b.vec_id as neighbor_id, list_distance(a.x, b.x) as d from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {every} = 0), "
        "r as (select *, row_number() over (partition by vec_id order by d, neighbor_id) as rank from p) "
        f"select vec_id, rank, neighbor_id, round(d, 6) as distance from r where rank <= {k}"
    )
