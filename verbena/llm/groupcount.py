"""Lines that documents of at least so many groups of near copies have, without the search of all pairs.

The groups are those of ``simhash.groups``: connected components, here of fingerprints, that near copies, far copies with
common words and doc_ids of several texts link. Both bounds of a line's count are exact:

- From above: near pairs among the line's own fingerprints join some of them; what stays apart are at least as many as the groups.
- From below: a few fingerprints of the line that stay apart are held against all fingerprints, then what they meet, and so on. A
  component of which all have been held against all others is a whole group, and two whole groups are different.

So the work is the fingerprints times a few of each line that the first bound leaves open. Lines that neither bound decides are
counted by ``simhash.groups``, as all are if the few would be too many for the driver or not cheaper than that search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import cut
from . import simhash
from .common import keep
from .simhash import BITS, FAR_DIFF, MAX_DIFF

_BYTES = BITS // 8
_WORDS = BITS // 64
#: Fingerprints of a line that one task joins (of a line with more, a sample), and seeds of a line beyond the groups it needs.
HELD = 4096
MORE = 54
#: Seeds that are held against all fingerprints: so many or a share of those, and what the driver takes of seeds, edges and texts of repeated ids.
SEEDS = 4096
SHARE = 16
ROWS = 1 << 19
#: Seeds and fingerprints that are compared at once.
HIGH = 16
WIDE = 1 << 12
#: Components with more that is not yet held against all aren't followed, nor any for more rounds.
FOLLOWED = 256
ROUNDS = 8


def apart(fps: list[bytes]) -> list[bytes]:
    """The first of each component of near pairs; what is no fingerprint is one of its own."""
    at = [k for k, x in enumerate(fps) if len(x) == _BYTES]
    first = np.arange(len(fps))
    if len(at) > 1:
        fp = np.frombuffer(b"".join(fps[k] for k in at), np.uint64).reshape(-1, _WORDS)
        order = simhash.gray_order(fp)
        root = simhash._forest(fp[order], MAX_DIFF)
        place = np.asarray(at)[order]
        least = np.full(len(root), len(fps))
        np.minimum.at(least, root, place)
        first[place] = least[root]
    return [fps[k] for k in np.unique(first).tolist()]


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each line of a task, some fingerprints that stay apart, and whether they are all; none if they are fewer than it needs."""
    held: dict[tuple[int, int], list] = {}
    for b in batches:
        for h, g, m, need, fp in zip(*(c.to_pylist() for c in b.columns)):
            held.setdefault((h, g), [m, need, []])[2].append(fp)
    out: list[tuple] = []
    for (h, g), (m, need, fps) in held.items():
        size, most = 64, need + MORE
        while len(found := apart(fps[:size])) < most and size < len(fps):
            size *= 8
        if len(found) < need and m <= min(size, len(fps)):
            continue
        whole = len(found) <= most and m <= min(size, len(fps))
        out += [(h, g, need, whole, fp) for fp in found[:most]]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    columns = zip(*out) if out else ((),) * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["h", "g", "need", "whole", "fp"])


def _met_batches(seeds: list[bytes]):
    """All pairs within the far limit of a seed, by its place, and another fingerprint."""
    s = np.frombuffer(b"".join(seeds), np.uint64).reshape(-1, _WORDS)
    mine = np.ascontiguousarray(s.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = [np.empty(HIGH * WIDE, t) for t in (np.uint64, np.uint8, np.uint8)]
        for b in batches:
            fp = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, _WORDS)
            theirs = np.ascontiguousarray(fp.T)
            found = []
            for at in range(0, len(fp), WIDE):
                y = theirs[:, None, at : at + WIDE]
                for lo in range(0, len(s), HIGH):
                    x = mine[:, lo : lo + HIGH, None]
                    shape = x.shape[1], y.shape[2]
                    size = shape[0] * shape[1]
                    xor, one, d = (a[:size].reshape(shape) for a in room)
                    np.bitwise_count(np.bitwise_xor(x[0], y[0], out=xor), out=d)
                    for w in range(1, _WORDS):
                        np.add(d, np.bitwise_count(np.bitwise_xor(x[w], y[w], out=xor), out=one), out=d)
                    # 256 differences are 0 here, so what is found is looked at again
                    if d.min() <= FAR_DIFF:
                        i, j = np.nonzero(d <= FAR_DIFF)
                        found.append(np.stack((i + lo, j + at)))
            i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            d = np.bitwise_count(s[i] ^ fp[j]).sum(axis=1, dtype=np.int32)
            ok = (d > 0) & (d <= FAR_DIFF)
            i, j, d = i[ok], j[ok], d[ok]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), b.column(0).take(pa.array(j)), b.column(1).take(pa.array(j)), pa.array(d)], names=["seed", "fp", "id", "d"])

    return run


class _Components:
    """Components of fingerprints by the edges that are known."""

    def __init__(self) -> None:
        self.over: dict[bytes, bytes] = {}

    def root(self, x: bytes) -> bytes:
        self.over.setdefault(x, x)
        while self.over[x] != x:
            self.over[x] = x = self.over[self.over[x]]
        return x

    def join(self, x: bytes, y: bytes) -> None:
        x, y = self.root(x), self.root(y)
        self.over[max(x, y)] = min(x, y)

    def members(self) -> dict[bytes, list[bytes]]:
        out: dict[bytes, list[bytes]] = {}
        for x in list(self.over):
            out.setdefault(self.root(x), []).append(x)
        return out


def _rows(df: DataFrame) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in df.toArrow().columns))


def _decided(lines: dict, nodes: DataFrame, ids: dict[bytes, int], twice: list[tuple[int, bytes]], most: int, docs: DataFrame, id_col: str, text_col: str) -> dict[tuple[int, int], bool]:
    """Whether lines (h, g) -> (need, whole, seeds) are in so many groups; those that stay open are left out."""
    spark = docs.sparkSession
    known, done, decided = _Components(), set(), {}
    first: dict[int, bytes] = {}
    for doc_id, fp in twice:
        known.join(first.setdefault(doc_id, fp), fp)
    taken = {line: need for line, (need, _, _) in lines.items()}
    front = {fp for need, _, fps in lines.values() for fp in fps[:need]}
    for _ in range(ROUNDS):
        if not front or len(front) + len(done) > most:
            break
        done |= front
        if seeds := sorted(x for x in front if len(x) == _BYTES):
            met = cut(nodes.where(F.length("fp") == _BYTES).select("fp", "id").mapInArrow(_met_batches(seeds), "seed int, fp binary, id bigint, d int"))
            if met.count() > ROWS:
                return decided
            far: list[tuple[bytes, bytes]] = []
            for k, y, i, d in _rows(met):
                ids[y] = i
                if d > MAX_DIFF:
                    far.append((seeds[k], y))
                else:
                    known.join(seeds[k], y)
            far = [(x, y) for x, y in far if known.root(x) != known.root(y)]
            if far:
                pair = {(x, y): (min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in far}
                pairs = spark.createDataFrame(sorted(set(pair.values())), "a bigint, b bigint")
                alike = {tuple(r) for r in simhash.overlapping(pairs, docs, id_col, text_col).collect()}
                for x, y in far:
                    if pair[x, y] in alike:
                        known.join(x, y)
        # what of each component hasn't been held against all
        unmet = {r: [x for x in own if x not in done] for r, own in known.members().items()}
        front = set()
        for line, (need, whole, fps) in lines.items():
            if line in decided:
                continue
            roots = {known.root(fp) for fp in fps}
            closed = sum(not unmet[r] if r in unmet else r in done for r in roots)
            if closed >= need:
                decided[line] = True
            elif whole and len(roots) < need:
                decided[line] = False
            else:
                tried = {known.root(fp) for fp in fps[: taken[line]]}
                front.update(*(unmet[r] for r in tried if r in unmet and len(unmet[r]) <= FOLLOWED))
                more = fps[taken[line] : taken[line] + 2 * (need - closed)]
                taken[line] += len(more)
                front.update(x for x in more if x not in done)
    return decided


def lines_in_groups(held: DataFrame, docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines (h, g) of distinct rows (h, g, id) that documents of at least ``least`` groups have; rows without an id are of one more."""
    spark = docs.sparkSession
    often = keep(held.groupBy("h", "g").agg(F.count("*").alias("n"), F.max(F.col("id").isNull()).alias("no_id")).where(F.col("n") >= least))
    if often.isEmpty():
        return often.select("h", "g")
    prints = cut(simhash.fingerprint_table(docs, id_col, text_col).where("doc_id is not null").distinct())
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    rows = cut(held.join(often, ["h", "g"], "left_semi").join(prints, F.col("id") == F.col("doc_id")).select("h", "g", "fp").distinct())
    need = (F.lit(least) - F.col("no_id").cast("int")).alias("need")
    sizes = rows.groupBy("h", "g").agg(F.count("*").alias("m")).join(often, ["h", "g"]).select("h", "g", "m", need).where("m >= need")
    # one order for all lines, first the fingerprints of many of them, so that they share seeds
    opened = cut(rows.join(sizes, ["h", "g"]))
    shared = opened.groupBy("fp").agg(F.count("*").alias("lines"))
    order = Window.partitionBy("h", "g").orderBy(F.desc("lines"), F.xxhash64("fp"), "fp")
    some = opened.join(shared, "fp").withColumn("r", F.row_number().over(order)).where(F.col("r") <= HELD)
    # the rows of a line are in one task, in order
    seeds = cut(some.select("h", "g", "m", "need", "fp").mapInArrow(_seed_batches, "h bigint, g int, need int, whole boolean, fp binary"))
    twice = prints.join(prints.groupBy("doc_id").count().where("count > 1"), "doc_id", "left_semi").join(nodes, "fp").select("doc_id", "fp", "id")
    most = max(SEEDS, nodes.count() // SHARE)
    decided: dict[tuple[int, int], bool] = {}
    lines: dict[tuple[int, int], tuple[int, bool, list[bytes]]] = {}
    rest = seeds.select("h", "g").distinct()
    if seeds.count() <= ROWS and twice.count() <= ROWS:
        ids: dict[bytes, int] = {}
        for h, g, least_of, whole, fp, i in _rows(seeds.join(nodes, "fp").select("h", "g", "need", "whole", "fp", "id")):
            lines.setdefault((h, g), (least_of, whole, []))[2].append(fp)
            ids[fp] = i
        repeated = list(_rows(twice))
        ids.update((fp, i) for _, fp, i in repeated)
        decided = _decided(lines, nodes, ids, [(d, fp) for d, fp, _ in repeated], most, docs, id_col, text_col)
        rest = spark.createDataFrame([x for x in lines if x not in decided], "h bigint, g int")
    found = spark.createDataFrame([x for x, yes in decided.items() if yes], "h bigint, g int")
    if rest.isEmpty():
        return found
    of = simhash.groups(docs, id_col=id_col, text_col=text_col).where("doc_id <> group_id").select(F.col("doc_id").alias("i"), F.col("group_id").alias("r"))
    counted = held.join(rest, ["h", "g"], "left_semi").join(of, F.col("id") == F.col("i"), "left").select("h", "g", F.coalesce("r", "id").alias("id")).distinct()
    return found.union(counted.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h", "g"))
