"""Repeated passages by a hash-compared suffix sort.

A passage is repeated if a window of ``length`` words (between ASCII white space, as written)
stands at two places of the table; the result is the union of all such windows of each document.

Windows are dealt out by content: each one is represented by the least hash among its k-grams
(the leftmost on a tie), so equal windows have equal k-grams, at the same place in the window.
Consecutive windows with the same k-gram form one context, and only one small row a context
(about one for fifteen words) is written. K-grams are counted with a map-side sum; the contexts of
those that stand once are dropped, the others fetch their words. Equal contexts of a k-gram are put
together by their words. The suffixes of different ones, one for each window, are merge-sorted within
a k-gram, all groups of a batch in step. Suffixes are compared by their longest common extension,
found by binary search over prefix polynomial hashes, so a comparison takes log(length) steps;
neighbours that agree over the whole length are verified word for word, and a group with a collision
is sorted again by its words.

A k-gram with more than ``hot`` contexts (a boilerplate with as many surroundings, or a text with as
many copies) would be too much for one task. Its contexts, and then the windows of the different
ones, are grouped by their words instead, with a map-side sum, over all tasks. Either way a
window is reported for equal words, never for equal hashes alone.

Defined cases: a null text, or one of fewer than ``length`` words, has no passages; a null doc_id
is an id; repeated rows repeat each other, so their whole texts are passages, reported once for
each distinct (doc_id, text); rows of one doc_id with several texts are reported each with their
own positions; a window that overlaps its own repetition counts; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialise import cut
from .common import _SOLID_BYTES, POWERS, chunks, hash_spans, keep, mix64, prefixes, spans

LENGTH = 50
GRAM = 20
_SHIFT = np.int64(10)
SORT_WORDS = 1 << 20
HOT = 10_000


def contexts(texts: list[str | None], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text index, k-gram hash, first window, windows, offset of the k-gram) of each context."""
    out: list[tuple[np.ndarray, ...]] = []
    for lo, hi in chunks(texts):
        buf, start, end, of = spans([(t or "").encode("utf-8", "replace") for t in texts[lo:hi]], _SOLID_BYTES)
        n = len(start)
        if n < length:
            continue
        q = prefixes(hash_spans(buf, start, end))
        _, down = POWERS.upto(n + 1)
        grams = mix64((q[gram:] - q[:-gram]) * down[: n - gram + 1])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        whole = of[: n - length + 1] == of[length - 1 :]
        new = whole.copy()
        new[1:] &= ~whole[:-1] | (at[1:] != at[:-1]) | (of[1 : n - length + 1] != of[: n - length])
        first = np.flatnonzero(new)
        if not len(first):
            continue
        gone = np.flatnonzero(np.concatenate((~whole, [True])))
        stop = np.minimum(np.append(first[1:], n), gone[np.searchsorted(gone, first)])
        doc = of[first]
        base = np.searchsorted(of, doc)
        out.append((doc + lo, grams[at[first]], first - base, stop - first, at[first] - first))
    if not out:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out))


def _context_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, k, first, n, off = contexts(b.column(2).to_pylist(), length, gram)
            at = pa.array(doc)
            place = (first << (2 * _SHIFT)) | (n << _SHIFT) | off
            cols = [pa.array(k.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "id", "v", "place"])

    return run


def _fetch(length: int):
    """Rows (id, v, text, places) -> a row a context, with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = np.array(_words(b.column(2)[i].as_py()), object)
                todo = b.column(3)[i].values
                k, place, hot = todo.field(0), todo.field(1).to_numpy(), todo.field(2)
                first, n = place >> (2 * _SHIFT), (place >> _SHIFT) & ((1 << _SHIFT) - 1)
                for lo in range(0, len(k), 2048):
                    part = slice(lo, lo + 2048)
                    text = pa.array([" ".join(words[s : s + m + length - 1]) for s, m in zip(first[part], n[part])], pa.string())
                    at = pa.array(np.full(len(text), i))
                    yield pa.RecordBatch.from_arrays([k[part], b.column(0).take(at), b.column(1).take(at), pa.array(place[part]), hot[part], text], names=["k", "id", "v", "place", "hot", "words"])

    return run


def _words(text: str) -> list[str]:
    return [w for w in text.translate(_BLANKS).split(" ") if w]


_BLANKS = {9: " ", 10: " ", 13: " "}


class Suffixes:
    """Word sequences whose suffixes are compared by hash, up to ``length`` words."""

    def __init__(self, texts: list[str], length: int) -> None:
        self.length = length
        self.data = [t.encode("utf-8", "replace") for t in texts]
        self.buf, self.start, self.end, of = spans(self.data, _SOLID_BYTES)
        self.hashes = hash_spans(self.buf, self.start, self.end)
        self.q = prefixes(self.hashes)
        _, self.down = POWERS.upto(len(self.hashes) + 1)
        self.base = np.searchsorted(of, np.arange(len(texts)))

    def extension(self, p: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Words that the suffixes at p and r have in common, ``length`` at most: a binary search over prefix hashes."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length, np.int64)
        qp, qr, dp, dr = self.q[p], self.q[r], self.down[p], self.down[r]
        for _ in range(self.length.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.q[p + mid] - qp) * dp == (self.q[r + mid] - qr) * dr
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def below(self, p: np.ndarray, r: np.ndarray, or_equal: bool) -> np.ndarray:
        e = self.extension(p, r)
        full = e == self.length
        e[full] = 0
        return np.where(full, or_equal, self.hashes[p + e] < self.hashes[r + e])

    def words(self, p: int) -> bytes:
        return self.buf[self.start[p] : self.end[p + self.length - 1]].tobytes()

    def sort(self, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of (group, suffix), by a bottom-up merge sort of all groups in step."""
        order = np.argsort(group, kind="stable")
        p, group = p[order], group[order]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(p)))
        index = np.repeat(np.arange(len(begin)), size)
        width = 1
        while len(size) and width < size.max():
            at = np.flatnonzero(size[index] > width)
            origin, total = begin[index[at]], size[index[at]]
            local = at - origin
            run = local // width
            other = (run ^ 1) * width
            low = np.minimum(other, total)
            high = np.minimum(other + width, total)
            floor, right = low.copy(), (run & 1) == 1
            x = p[at]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) >> 1
                y = p[origin[open_] + mid]
                # how many of the other run go before this one: those below it, and for the right run those equal as well
                before = np.empty(len(open_), bool)
                r = right[open_]
                before[r] = self.below(y[r], x[open_][r], True)
                before[~r] = self.below(y[~r], x[open_][~r], False)
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            place = origin + (run & ~1) * width + (local - run * width) + (low - floor)
            p[place] = x.copy()
            width *= 2
        return p, index

    def repeated(self, p: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Those of the suffixes p that agree with another one of their group over the whole length."""
        p, index = self.sort(p, group)
        near = np.flatnonzero(index[1:] == index[:-1])
        near = near[self.extension(p[near], p[near + 1]) == self.length]
        verified = np.fromiter((self.words(p[i]) == self.words(p[i + 1]) for i in near), bool, len(near))
        hit = np.zeros(len(p), bool)
        hit[near[verified]] = hit[near[verified] + 1] = True
        for g in np.unique(index[near[~verified]]):  # a collision: this group by its words
            own = np.flatnonzero(index == g)
            keys = [self.words(p[i]) for i in own]
            hit[own] = [keys.count(x) > 1 for x in keys]
        return p[hit]


def _compare(length: int):
    """Rows (k, id, v, place, words) sorted by k -> passages (id, v, s, e) of those contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows * (length + 20)
            if size < SORT_WORDS:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            k = t.column("k").to_numpy()
            cutoff = int(np.searchsorted(k, k[-1]))
            if cutoff:
                yield solve(t.slice(0, cutoff))
            held = t.slice(cutoff).to_batches()
            size = sum(x.num_rows for x in held) * (length + 20)
        if held:
            yield solve(pa.Table.from_batches(held))

    def solve(t: pa.Table) -> pa.RecordBatch:
        k, place = t.column("k").to_numpy(), t.column("place").to_numpy()
        # equal contexts of a k-gram are one, by their words
        code = t.column("words").combine_chunks().dictionary_encode().indices.to_numpy()
        _, lead, of, many = np.unique(np.stack([k, code], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
        of = of.reshape(-1)
        n, off = (place[lead] >> _SHIFT) & ((1 << _SHIFT) - 1), place[lead] & ((1 << _SHIFT) - 1)
        text = Suffixes(t.column("words").take(pa.array(lead)).to_pylist(), length)
        row = np.repeat(np.arange(len(lead)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        p = text.base[row] + step
        _, gram = np.unique(k[lead], return_inverse=True)
        # equal windows have their k-gram at the same place
        found = text.repeated(p, gram[row] * (1 << int(_SHIFT) + 1) + off[row] - step + (1 << int(_SHIFT)))
        found = np.unique(np.concatenate([found, p[many[row] > 1]]))
        own = np.searchsorted(text.base, found, "right") - 1
        new = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (own[1:] != own[:-1])))[: len(found)]
        begin = np.flatnonzero(new)
        stop = np.append(begin[1:], len(found)) - 1 if len(begin) else begin
        # the stretches of each different context, for every context that is equal to it
        held = own[begin]
        start, size = np.searchsorted(held, np.arange(len(lead))), np.bincount(held, minlength=len(lead))
        times = size[of]
        i = np.repeat(np.arange(len(of)), times)
        at = np.repeat(start[of] - (np.cumsum(times) - times), times) + np.arange(len(i))
        first, base = place[i] >> (2 * _SHIFT), text.base[of[i]]
        cols = [t.column(x).take(pa.array(i)).combine_chunks() for x in ("id", "v")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(first + found[begin][at] - base), pa.array(first + found[stop][at] - base + length)], names=["id", "v", "s", "e"])

    return run


def _hot_windows(words: DataFrame, length: int) -> DataFrame:
    """Rows (k, id, v, place, words) of contexts of frequent k-grams -> passages (id, v, s, e), by grouping equal contexts and equal windows."""
    first = F.shiftright("place", 20)
    words = keep(words)
    each = keep(words.groupBy("k", "words").agg(F.count("*").alias("many")).withColumn("x", F.monotonically_increasing_id()))
    split = F.split("words", " ")
    windows = each.select("x", split.alias("w"), F.posexplode(F.sequence(F.lit(1), F.size(split) - (length - 1))).alias("s", "at"))
    windows = windows.select("x", "s", F.array_join(F.slice("w", F.col("at"), length), " ").alias("window"))
    again = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    hits = windows.join(again, "window", "left_semi").select("x", "s")
    named = words.join(each, ["k", "words"]).select("id", "v", first.alias("first"), (F.size(split)).alias("n"), "many", "x")
    whole = named.where("many > 1").select("id", "v", F.col("first").alias("s"), (F.col("first") + F.col("n")).alias("e"))
    part = named.where("many = 1").join(hits, "x").select("id", "v", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("s") + length).alias("e"))
    return whole.unionByName(part)


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Rows (doc_id, start_word, end_word): the maximal stretches of words that repeated windows cover; ``end_word`` is exclusive."""
    if not 0 < gram <= length < 1 << int(_SHIFT):
        raise ValueError("0 < gram <= length < 1024")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("v"), text.alias("text")).where("text is not null")
    rows = keep(base.mapInArrow(_context_rows(length, gram), f"k bigint, id {kind}, v bigint, place bigint"))
    # counted before anything meets by k-gram: a frequent one is a sum of each map task
    again = cut(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = rows.join(again, "k").select("k", "id", "v", "place", (F.col("n") > hot).alias("hot"))
    # repeated rows have the same words: they are fetched once and go as often as they repeat
    todo = repeated.groupBy(F.col("id").alias("i"), F.col("v").alias("w")).agg(F.collect_set(F.struct("k", "place", "hot")).alias("places"))
    fetched = base.join(todo, F.col("id").eqNullSafe(F.col("i")) & (F.col("v") == F.col("w"))).select("id", "v", "text", "places")
    words = fetched.mapInArrow(_fetch(length), f"k bigint, id {kind}, v bigint, place bigint, hot boolean, words string")
    every = None
    if not again.where(F.col("n") > hot).isEmpty():
        words = keep(words)
        every = _hot_windows(words.where("hot").select("k", "id", "v", "place", "words"), length)
    cold = words.where("not hot").select("k", "id", "v", "place", "words")
    found = cold.repartition("k").sortWithinPartitions("k").mapInArrow(_compare(length), f"id {kind}, v bigint, s bigint, e bigint")
    every = found if every is None else found.unionByName(every)

    doc = Window.partitionBy("id", "v").orderBy("s", "e")
    reach = F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans_ = islands.groupBy("id", "v", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return spans_.select(F.col("id").alias("doc_id"), "start_word", "end_word").distinct()
