"""Best-fit packing of documents into sequences of a fixed number of tokens, bulk-synchronously.

A document is cut into full pieces of ``capacity`` tokens, which are sequences of their own, and
a rest. Rests and gaps are range-sorted by size. A round is one sweep from the largest size down:
gaps are laid on a stack as their size is passed, and every rest takes the smallest open gap that
is not below it (its successor), larger rests first and equal ones by rank, a gap taking one rest
a round. Then the gaps are updated, and the sweeps repeat; when none matches, empty sequences are
opened, as many as the remaining tokens, or the remaining rests above half the capacity, need.

Equal sizes differ only by rank, so the sweeps run over runs (size, first rank, length): a table
of at most ``capacity`` runs of rests, however many documents there are. Ranking the rests and
placing each by its run is distributed; a rank never puts a whole size class into one task.

Defined cases: every row is packed, so a repeated row (same doc_id and length) is packed again as
a further ``copy``; a null doc_id is packed as any other; a row without tokens (null or empty
text) gets one row of ``n_tokens`` 0 and a null ``seq_id``; a text of exactly ``capacity`` is one
full piece; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import cut
from .common import running_total, word_count

CAPACITY = 2048
BUCKETS = 64
#: Repeated rows that one task numbers at a time.
COPIES = 65_536


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place ``counts[size]`` rests of each size: runs (size, rank, length, sequence, offset), and the number of sequences."""
    left = {s: (0, n) for s, n in counts.items() if n > 0}
    gaps: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0
    while left:
        stack: list[tuple[int, int, int]] = []
        updated: dict[int, list[tuple[int, int]]] = {}
        matched = False
        for size in sorted(left.keys() | gaps.keys(), reverse=True):
            stack += [(size, seq, n) for seq, n in gaps.get(size, ())]
            rank, n = left.get(size, (0, 0))
            while n and stack:
                gap, seq, room = stack.pop()
                k = min(n, room)
                runs.append((size, rank, k, seq, capacity - gap))
                if gap > size:
                    updated.setdefault(gap - size, []).append((seq, k))
                if room > k:
                    stack.append((gap, seq + k, room - k))
                rank, n, matched = rank + k, n - k, True
            if size in left:
                left[size] = (rank, n)
        left = {s: x for s, x in left.items() if x[1]}
        gaps = updated
        for gap, seq, n in stack:
            gaps.setdefault(gap, []).append((seq, n))
        gaps = {g: _joined(x) for g, x in gaps.items()}
        if not matched and left:
            tokens = sum(s * n for s, (_, n) in left.items())
            new = max(-(-tokens // capacity), sum(n for s, (_, n) in left.items() if 2 * s > capacity))
            gaps.setdefault(capacity, []).append((opened, new))
            opened += new
    return runs, opened


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of sequences in falling order (so that the lowest is on top of the stack), neighbours joined."""
    out: list[tuple[int, int]] = []
    for seq, n in sorted(runs):
        if out and sum(out[-1]) == seq:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((seq, n))
    return out[::-1]


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (seq_id, seq_offset, doc_id, copy, doc_tokens, piece, start, n_tokens), one a piece."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), word_count(F.col(text_col)).alias("doc_tokens"))
    # rows of one doc_id and length are counted, and numbered again; a great many of them are dealt out in runs of COPIES
    counted = cut(rows.groupBy("doc_id", "doc_tokens").agg(F.count("*").alias("n")))
    runs_ = counted.where("n > 1").select("doc_id", "doc_tokens", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("run")).repartition("doc_id", "doc_tokens", "run")
    again = runs_.select("doc_id", "doc_tokens", F.explode(F.expr(f"sequence(run * {COPIES}, least(n, (run + 1) * {COPIES}) - 1)")).alias("copy"))
    units = counted.where("n = 1").select("doc_id", "doc_tokens", F.lit(0).cast("bigint").alias("copy")).unionByName(again)
    units = cut(
        units.withColumns(
            {"full": F.expr(f"doc_tokens div {capacity}"), "rest": F.col("doc_tokens") % capacity, "one": F.lit(1), "bucket": F.pmod(F.coalesce(F.hash("doc_id", "copy"), F.lit(0)), F.lit(BUCKETS))}
        )
    )
    classes = units.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).orderBy("rest").collect()
    runs, opened = sweep({r["rest"]: r["n"] for r in classes if r["rest"]}, capacity)
    bases, at = [], opened
    for r in classes:
        bases.append((r["rest"], at))
        at += r["full"]
    run_table = spark.createDataFrame(runs or [], "r_rest bigint, r_rank bigint, r_n bigint, r_seq bigint, r_offset bigint")
    base_table = spark.createDataFrame(bases or [], "b_rest bigint, base bigint")
    ranked = running_total(units, ["rest"], "bucket", ["doc_id", "doc_tokens", "copy"], {"rank": "one", "fulls": "full"})

    same = ["doc_id", "copy", "doc_tokens"]
    rests = ranked.where("rest > 0").join(run_table, (F.col("rest") == F.col("r_rest")) & (F.col("rank") >= F.col("r_rank")) & (F.col("rank") < F.col("r_rank") + F.col("r_n")))
    rests = rests.select((F.col("r_seq") + F.col("rank") - F.col("r_rank")).alias("seq_id"), F.col("r_offset").alias("seq_offset"), *same, F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("n_tokens"))
    zero = F.lit(0).cast("bigint")
    fulls = ranked.where("full > 0").join(base_table, F.col("rest") == F.col("b_rest")).withColumn("piece", F.explode(F.expr("sequence(0L, full - 1)")))
    fulls = fulls.select((F.col("base") + F.col("fulls") + F.col("piece")).alias("seq_id"), zero.alias("seq_offset"), *same, "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    none = units.where("doc_tokens = 0").select(F.lit(None).cast("bigint").alias("seq_id"), zero.alias("seq_offset"), *same, zero.alias("piece"), zero.alias("start"), zero.alias("n_tokens"))
    return rests.unionByName(fulls).unionByName(none)
