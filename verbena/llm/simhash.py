"""SimHash near-dedup with a Gray-order index of blocks of bits.

A fingerprint has 256 bits: the signs of the sums of the hashed distinct words (lower case,
without punctuation). Two documents are near copies if their fingerprints differ in at most
``max_diff`` bits, or in at most ``far_diff`` bits where at least ``OVERLAP`` of their distinct words
(Jaccard) are common; a few changed words of a short text move many bits. Equal fingerprints are first collapsed.
Among the rest, the search finds every pair within the limits. Up to ``SMALL`` fingerprints are sorted by Gray rank; runs of
``FANOUT`` become leaf nodes, runs of nodes become upper nodes; a node holds the bit pattern that all
below it share and the mask of those bits. Pairs of nodes are compared from the top: differences in the bits that both share are
counted, and the pair is dropped, with all below it, once they exceed ``max_diff``.

Random bits share little, so of a larger table that walk would drop little above its leaves. There the leaves are made
of equal bits: of a pair that differs in at most 56 bits, one of the four 64-bit words differs in at most 14 in the first or 13 in another
(57 = 15 + 14 + 14 + 14), and in that word one of its four blocks of 16 bits in at most 3 or 2 (15 = 4 + 4 + 4 + 3, 14 = 4 + 4 + 3 + 3).
For each block, those of an equal block are nodes, and a node has its words compared with those of all nodes
whose blocks differ in so few bits, which are put together for it from runs of sorted words. The fingerprints are dealt to groups
of at most about ``GROUP``; a task has two groups and one word. The work is quadratic, but reaches a ninth of the pairs, with one word each.

Near pairs become a spanning forest of the task, so thousands of mutual copies give thousands of edges and
not millions, and runs of joined copies aren't compared again; connected components of all forests are the groups, and the least doc_id stays.
Only pairs of the far range that the near ones don't join in their task have their words compared.

Defined cases: a text without words (null, empty, only punctuation) has no fingerprint; such texts
are copies of each other if they are equal but for white space around them, a null one counting as
empty, and near copies of nothing else; rows with a null doc_id take no part and are kept; if rows
of one doc_id have several texts, they link their groups, and if the doc_id stays, ``dedup`` keeps one
row of each of its texts, the first by its other columns (as JSON); ids are integers (cast to BIGINT); an empty
table gives an empty result; further columns are carried unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.materialise import cut
from .common import chunks, fresh, keep, mix64, word_hashes

BITS = 256
MAX_DIFF = 40
FAR_DIFF = 56
OVERLAP = 0.6
#: Drawn bits of a key, and what a pair at the far limit shares one of all draws' keys with. They only bring copies together early.
KEY_BITS = 10
RECALL = 0.9
FANOUT = 32
#: Tables of up to so many fingerprints are one walk down the index; larger ones are groups of at least LEAST and about GROUP at most.
SMALL = 4096
LEAST = 1 << 18
GROUP = 3 << 18
#: Pairs of words that are compared at once, of so many right ones at most, and pairs of a node from which on the joined ones are looked for first.
STEP = 1 << 16
WIDE = 1 << 13
MANY = 1 << 17
#: Pairs whose words one task compares, and documents whose words it holds, about.
PAIRS = 1 << 17
TEXTS = 1 << 15
_WORDS = BITS // 64
_BLOCKS = 4


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """SimHash of each text as rows of four uint64, and zeros with a false flag where it has no word."""
    out = np.zeros((len(texts), _WORDS), np.uint64)
    has = np.zeros(len(texts), bool)
    for lo, hi in chunks(texts):
        h, of = word_hashes(texts[lo:hi])
        if not len(h):
            continue
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[first], of[first]
        starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        n = np.diff(np.append(starts, len(of)))
        for w in range(_WORDS):
            bits = np.unpackbits(mix64(h + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            out[lo + of[starts], w] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        has[lo + of[starts]] = True
    return out, has


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        fp, has = fingerprints(texts)
        data = [fp[i].tobytes() if has[i] else md5((t or "").strip().encode("utf-8", "replace")).digest() for i, t in enumerate(texts)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["doc_id", "fp"])


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        words = []
        for lo, hi in chunks(texts):
            h, of = word_hashes(texts[lo:hi])
            at = np.searchsorted(of, np.arange(hi - lo + 1))
            words += [np.unique(h[at[i] : at[i + 1]]).view(np.int64) for i in range(hi - lo)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int64()))], names=["id", "words"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp); a text without words has the 16 bytes of its MD5, which is no fingerprint."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_fingerprint_batches, "doc_id bigint, fp binary")


@lru_cache
def draws(key_bits: int, far_diff: int = FAR_DIFF) -> np.ndarray:
    """As many draws of bits as let a pair that differs in ``far_diff`` of them meet with RECALL: a row for each."""
    same = np.prod((BITS - far_diff - np.arange(key_bits)) / (BITS - np.arange(key_bits)))
    bands = int(np.ceil(np.log(1 - RECALL) / np.log1p(-same)))
    return np.stack([np.random.default_rng(100 + b).permutation(BITS)[:key_bits] for b in range(bands)])


def band_keys(fp: np.ndarray, key_bits: int = KEY_BITS, bands: int | None = None) -> np.ndarray:
    """Keys of drawn bits of fingerprints: a column for each draw, or the first ``bands``, its number in the upper bits."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    weight = 1 << np.arange(key_bits, dtype=np.int64)
    return np.stack([bits[:, d].astype(np.int64) @ weight + (b << key_bits) for b, d in enumerate(draws(key_bits)[:bands])], axis=1)


def gray_order(fp: np.ndarray) -> np.ndarray:
    """Order by Gray rank: bit i of the rank is the parity of the bits from the top down to i."""
    rank = np.zeros_like(fp)
    carry = np.zeros(len(fp), np.uint64)
    for w in range(fp.shape[1]):
        x = fp[:, w].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        rank[:, w] = x ^ (carry * np.uint64(0xFFFFFFFFFFFFFFFF))
        carry = rank[:, w] & np.uint64(1)
    return np.lexsort(tuple(rank[:, w] for w in range(fp.shape[1] - 1, -1, -1)))


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pattern, mask) of the nodes of each level, leaves (single fingerprints) first."""
    levels = [(fp, np.full_like(fp, 0xFFFFFFFFFFFFFFFF))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        shared = np.bitwise_and.reduceat(mask, at, axis=0)
        ones, zeros = np.bitwise_and.reduceat(pattern | ~mask, at, axis=0), np.bitwise_and.reduceat(~pattern | ~mask, at, axis=0)
        levels.append((ones & shared, (ones | zeros) & shared))
    return levels


def _near(p, m, i, j, max_diff):
    d = np.zeros(len(i), np.uint16)
    for w in range(p.shape[1]):
        d += np.bitwise_count((p[i, w] ^ p[j, w]) & m[i, w] & m[j, w])
    return d <= max_diff


def near_pairs(fp: np.ndarray, max_diff: int = MAX_DIFF, step: int = 1 << 18, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i < j) of Gray-ordered fingerprints within ``max_diff`` bits, by a walk down the index.

    With ``root``, which the caller updates in place as it joins the pairs, pairs that are joined already
    are left out, and so are pairs of nodes of which all members are: a large group of mutual copies
    then costs about its size and not its square.
    """
    levels = _levels(fp)
    top = len(levels) - 1
    i, j = np.triu_indices(len(levels[top][0]))
    stack = [(top, i, j)]
    least: list[np.ndarray] = []
    done = len(fp)
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack += [(level, i[a : a + step], j[a : a + step]) for a in range(0, len(i), step)]
            continue
        p, m = levels[level]
        if root is not None:
            if done >= len(fp):
                least, done = _uniform(root, len(levels)), 0
            done += len(i)
            one = root if level == 0 else least[level]
            apart = (one[i] != one[j]) | (one[i] < 0)
            if level == 0:
                apart |= i == j
            i, j = i[apart], j[apart]
        keep = _near(p, m, i, j, max_diff)
        i, j = i[keep], j[keep]
        if level == 0:
            i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        size = len(levels[level - 1][0])
        room = max(1, step // FANOUT**2)
        a, b = np.divmod(np.arange(FANOUT**2), FANOUT)
        for at in range(0, len(i), room):
            x = (i[at : at + room, None] * FANOUT + a).ravel()
            y = (j[at : at + room, None] * FANOUT + b).ravel()
            ok = (x <= y) & (y < size)
            stack.append((level - 1, x[ok], y[ok]))


def _uniform(root: np.ndarray, levels: int) -> list[np.ndarray]:
    """For the nodes of each level, the root that all below share, or -1."""
    out = [root]
    for _ in range(levels - 1):
        below = out[-1]
        at = np.arange(0, len(below), FANOUT)
        low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
        out.append(np.where(low == high, low, -1))
    return out


def _forest(fp: np.ndarray, max_diff: int) -> np.ndarray:
    """The least member of each one's component under the near pairs of Gray-ordered fingerprints."""
    root = np.arange(len(fp))
    for i, j in near_pairs(fp, max_diff, root=root):
        _join(root, i, j)
    return root


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Update ``root``, the least members of components, in place by the pairs (i, j)."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def shares(limit: int, parts: int) -> list[int]:
    """Limits of parts, -1 for none, of which one holds if at most ``limit`` bits differ in all: each and 1 add up to limit + 1."""
    return [(limit + 1) // parts + (k < (limit + 1) % parts) - 1 for k in range(parts)]


@lru_cache
def _masks(radius: int) -> list[np.ndarray]:
    """The 16-bit differences of each number of bits up to ``radius``."""
    x = np.arange(1 << 16, dtype=np.int32)
    return [x[np.bitwise_count(x) == k] for k in range(radius + 1)]


def _block_pairs(left: np.ndarray, right: np.ndarray, block: int, radius: int, within: int, own: bool, root: np.ndarray, start_of_right: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of words that differ in at most ``within`` bits and in ``block`` in at most ``radius``; with ``own``, left is right and each pair comes once or twice.

    Left words of one node, blocks that are equal but for the last bits of their high bytes, are compared with all right ones in its reach at once.
    Those are put together from runs: for a low byte, the right words whose low bytes differ in at most 0, 1, ... bits lie in the order of their high
    bytes, so a node whose first bits differ in m has one run, of those that differ in ``radius - m`` more. Small tables have larger nodes.
    Where many meet, pairs of one root are passed over; ``root`` has right ones from ``start_of_right`` on.
    """
    shift = np.uint64(16 * block)
    last = 0
    while last < 4 and len(left) << last < 1 << 18:
        last += 1
    nodes = 256 >> last
    key = (left >> shift).astype(np.uint16)
    order = np.argsort(key.byteswap(), kind="stable").astype(np.int32)
    start = np.concatenate(([0], np.cumsum(np.bincount(key.byteswap(), minlength=1 << 16))))[:: 1 << last].tolist()
    words = left[order]
    key = (right >> shift).astype(np.uint16)
    other = np.argsort(key, kind="stable").astype(np.int32)
    others, key = right[other], key[other]
    low = (key & np.uint16(255)).astype(np.uint8)
    ends = np.searchsorted(key, np.arange(nodes + 1) << 8 + last)
    byte = np.arange(256, dtype=np.uint8)
    reach = [(h, radius - h.bit_count()) for h in np.unique(np.concatenate(_masks(radius)) >> 8 + last).tolist()]
    xs, counts = np.empty(STEP, np.uint64), np.empty(STEP, np.uint8)
    for mine in range(256):
        if start[mine * nodes] == start[(mine + 1) * nodes]:
            continue
        apart = np.take(np.bitwise_count(byte ^ np.uint8(mine)), low)
        at, runs, places = np.flatnonzero(apart <= radius), [], []
        apart, w, o = apart[at], others[at], other[at]
        for r in range(radius, -1, -1):
            if r < radius:
                some = apart <= r
                at, apart, w, o = at[some], apart[some], w[some], o[some]
            bounds = np.searchsorted(at, ends).tolist()
            runs.append([w[x:y] for x, y in pairwise(bounds)])
            places.append([o[x:y] for x, y in pairwise(bounds)])
        runs, places = runs[::-1], places[::-1]
        for node in range(nodes):
            lo, hi = start[mine * nodes + node], start[mine * nodes + node + 1]
            if lo == hi:
                continue
            near = [(r, node ^ h) for h, r in reach if not own or node ^ h >= node]
            y = np.concatenate([runs[r][h] for r, h in near])
            if not len(y):
                continue
            x, i, j = words[lo:hi], order[lo:hi], None
            sets = [(x, i, y, j)]
            if len(x) * len(y) > MANY and (often := _often(root[i])):
                j = np.concatenate([places[r][h] for r, h in near])
                sets = _unjoined(x, i, y, j, root[i], root[start_of_right + j], often)
            for x, i, y, j in sets:
                for b in range(0, len(y), WIDE):
                    q = y[b : b + WIDE]
                    rows = STEP // len(q)
                    for a in range(0, len(x), rows):
                        p = x[a : a + rows, None]
                        size = len(p) * len(q)
                        np.bitwise_xor(p, q, out=xs[:size].reshape(len(p), -1))
                        found = np.bitwise_count(xs[:size], out=counts[:size]).reshape(len(p), -1)
                        some = np.flatnonzero(found.min(axis=0) <= within)
                        if len(some):
                            if j is None:
                                j = np.concatenate([places[r][h] for r, h in near])
                            m, n = np.nonzero(found[:, some] <= within)
                            yield i[a + m], j[b + some[n]]


def _often(root: np.ndarray) -> list[int]:
    """Roots that many have."""
    roots, n = np.unique(root, return_counts=True)
    return roots[n >= 64].tolist()


def _unjoined(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, mine: np.ndarray, theirs: np.ndarray, often: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The words x at i and y at j in parts whose pairs are all but those of the roots ``often``; ``mine`` and ``theirs`` are their roots."""
    parts, rest = [], np.ones(len(x), bool)
    for r in often:
        own, ok = mine == r, theirs != r
        rest &= ~own
        parts.append((x[own], i[own], y[ok], j[ok]))
    return [*parts, (x[rest], i[rest], y, j)]


def _alike(fp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    d = np.zeros(len(i), np.uint16)
    for w in range(_WORDS):
        d += np.bitwise_count(fp[i, w] ^ fp[j, w])
    return d


def _bring_together(fp: np.ndarray, root: np.ndarray, max_diff: int, bands: int = 4) -> None:
    """Join near copies that stand side by side in the order of a few keys: most of a large group, so that its rows are passed over."""
    keys = np.concatenate([band_keys(fp[lo : lo + (1 << 16)], 16, bands) for lo in range(0, len(fp), 1 << 16)])
    for key in keys.T:
        order = np.argsort(key, kind="stable")
        near = _alike(fp, order[:-1], order[1:]) <= max_diff
        _join(root, order[:-1][near], order[1:][near])


def word_edges(fp: np.ndarray, split: int, word: int, max_diff: int, far_diff: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots under near pairs, and the far pairs they leave apart, of all pairs in the limits whose ``word`` differs in its share of bits at most.

    Pairs are of a fingerprint before ``split`` and one from there on, or of any two if split is the number of all.
    """
    root = np.arange(len(fp))
    limit = max(max_diff, far_diff)
    within = shares(limit, _WORDS)[word]
    own = split == len(fp)
    a = np.arange(split)
    b = a if own else np.arange(split, len(fp))
    near: list[tuple[np.ndarray, np.ndarray]] = []
    far: list[np.ndarray] = [np.zeros(0, np.int64)]
    waiting = 0
    _bring_together(fp, root, max_diff)

    def settle() -> None:
        nonlocal waiting
        if near:
            _join(root, np.concatenate([x for x, _ in near]), np.concatenate([y for _, y in near]))
        pairs = np.unique(np.concatenate(far))
        i, j = np.divmod(pairs, len(fp))
        near.clear()
        far[:] = [pairs[root[i] != root[j]]]
        waiting = 0

    def look(pairs: list[np.ndarray]) -> None:
        """Keep those of the pairs that are apart and within the limits."""
        nonlocal waiting
        i, j = pairs
        ok = root[i] != root[j]
        i, j = i[ok], j[ok]
        d = _alike(fp, i, j)
        near.append((i[d <= max_diff], j[d <= max_diff]))
        ok = (d > max_diff) & (d <= far_diff)
        far.append(np.minimum(i[ok], j[ok]) * len(fp) + np.maximum(i[ok], j[ok]))
        waiting += len(near[-1][0]) + len(far[-1])
        if waiting > 1 << 16:
            settle()

    left, right = fp[a, word], fp[b, word]
    for block, radius in enumerate(shares(within, _BLOCKS)):
        if radius < 0:
            continue
        settle()
        met, size = [], 0
        for i, j in _block_pairs(left, right, block, radius, within, own, root, 0 if own else split):
            met.append((a[i], b[j]))
            size += len(i)
            if size > 1 << 18:
                look([np.concatenate(x) for x in zip(*met)])
                met, size = [], 0
        if met:
            look([np.concatenate(x) for x in zip(*met)])
    settle()
    i, j = np.divmod(far[0], len(fp))
    return root, i, j


def _deal(count: int, words: int):
    """Fingerprints as packed rows for each task: tasks are pairs of ``count`` groups, the first not above the second, times ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, _WORDS)
            group = (mix64(ids.view(np.uint64)) % np.uint64(count)).astype(np.int64)
            for g in np.unique(group).tolist():
                own = group == g
                data = ids[own].tobytes(), fp[own].tobytes()
                for h in range(count):
                    low, high = min(g, h), max(g, h)
                    task = (high * (high + 1) // 2 + low) * words + np.arange(words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task.astype(np.int32)), pa.array([g > h] * words), pa.array([data[0]] * words, pa.binary()), pa.array([data[1]] * words, pa.binary())],
                        names=["task", "second", "ids", "fps"],
                    )

    return run


def _task_edges(words: int, max_diff: int, far_diff: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[tuple[bytes, bytes]], list[tuple[bytes, bytes]]]] = {}
        for b in batches:
            for task, second, ids, fps in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault(task, ([], []))[second].append((ids, fps))
        for task in sorted(held):
            parts = held.pop(task)
            ids = np.frombuffer(b"".join(x for side in parts for x, _ in side), np.int64)
            fp = np.frombuffer(b"".join(x for side in parts for _, x in side), np.uint64).reshape(-1, _WORDS)
            # two groups: pairs across them; one: any
            diagonal = any(task // words == g * (g + 3) // 2 for g in range(task + 1)) if not parts[1] else False
            split = sum(len(x) // 8 for x, _ in parts[0])
            del parts
            if not diagonal and not 0 < split < len(ids):
                continue
            if words == 1:
                order = gray_order(fp)
                ids, fp = ids[order], fp[order]
                root = _forest(fp, max_diff)
                far = [*near_pairs(fp, far_diff, root=root)] if far_diff > max_diff else []
                i, j = (np.concatenate([p[k] for p in far]) if far else np.zeros(0, np.int64) for k in (0, 1))
            else:
                root, i, j = word_edges(fp, split, task % words, max_diff, far_diff)
            low = np.flatnonzero(root != np.arange(len(root)))
            i, j, is_far = np.concatenate((low, i)), np.concatenate((root[low], j)), np.arange(len(low) + len(i)) >= len(low)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(is_far)], names=["a", "b", "far"])

    return run


def _overlaps(overlap: float):
    """Of each cell, first the words of its documents and then its pairs: the pairs of which two texts overlap."""

    def alike(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(x) for x in many])
        flat = np.concatenate(many)
        at = np.searchsorted(one, flat)
        at[at == len(one)] = 0
        n = np.add.reduceat(one[at] == flat, np.cumsum(size) - size, dtype=np.int64)
        return (n > 0) & (n >= overlap * (len(one) + size - n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = -1, {}
        for batch in batches:
            cells, a, b, words = batch.columns
            cells, a, is_pair = cells.to_numpy(), a.to_numpy(), b.is_valid().to_numpy(zero_copy_only=False)
            b = b.fill_null(0).to_numpy()
            found: list[tuple[int, int]] = []
            for cell in np.unique(cells).tolist():
                if cell != now:
                    now, texts = cell, {}
                for k in np.flatnonzero((cells == cell) & ~is_pair).tolist():
                    texts.setdefault(int(a[k]), []).append(words[k].values.to_numpy().view(np.uint64))
                mine = np.flatnonzero((cells == cell) & is_pair)
                mine = mine[np.argsort(a[mine], kind="stable")]
                for run_of in np.split(mine, np.flatnonzero(np.diff(a[mine])) + 1):
                    of = [(y, t) for y in b[run_of].tolist() for t in texts.get(y, ())]
                    for one in texts.get(int(a[run_of[0]]), ()) if of else ():
                        found += [(int(a[run_of[0]]), of[k][0]) for k in np.flatnonzero(alike(one, [t for _, t in of])).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def near_edges(distinct: DataFrame, max_diff: int = MAX_DIFF, far_diff: int = FAR_DIFF) -> DataFrame:
    """Rows (a, b, far) among rows (id, fp) of distinct fingerprints: edges that connect all pairs in ``max_diff``, and all pairs in ``far_diff`` that near ones leave apart."""
    n = distinct.count()
    words = 1 if n <= SMALL else _WORDS
    count = max(1, -(-n // min(GROUP, max(LEAST, -(-n // 4)))))
    tasks = count * (count + 1) // 2 * words
    dealt = distinct.select("id", "fp").mapInArrow(_deal(count, words), "task int, second boolean, ids binary, fps binary")
    return dealt.repartitionById(tasks, F.col("task")).mapInArrow(_task_edges(words, max_diff, far_diff), "a bigint, b bigint, far boolean").distinct()


def overlapping(pairs: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlap: float = OVERLAP) -> DataFrame:
    """The pairs (a, b) of doc_ids of which two texts have at least ``overlap`` of their distinct words in common."""
    pairs = cut(pairs.distinct())
    # as a table its size is known: a small one is broadcast and the texts of the other documents are not moved
    ids = keep(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct())
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).join(ids, F.col("id") == F.col("i"), "left_semi")
    words = cut(texts.mapInArrow(_word_batches, "id bigint, words array<bigint>").where(F.size("words") > 0))
    # a square of cells: a document's words go once to each cell that has a pair of it, and not with every pair
    side = max(1, ceil((pairs.count() / PAIRS) ** 0.5), ceil(2 * ids.count() / TEXTS))
    cell = F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side))
    dealt = pairs.select(cell.cast("int").alias("cell"), "a", "b")
    sent = dealt.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(words, "id")
    rows = sent.select("cell", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "words").unionByName(dealt.withColumn("words", F.lit(None).cast("array<bigint>")))
    sorted_rows = rows.repartitionById(side * side, F.col("cell")).sortWithinPartitions("cell", F.col("b").asc_nulls_first())
    return sorted_rows.mapInArrow(_overlaps(overlap), "a bigint, b bigint").distinct()


def groups(docs: DataFrame, max_diff: int = MAX_DIFF, id_col: str = "doc_id", text_col: str = "text", far_diff: int = FAR_DIFF) -> DataFrame:
    """Rows (doc_id, group_id, is_kept) for every distinct doc_id; group_id is the group's least doc_id."""
    prints = cut(fingerprint_table(docs, id_col, text_col).where("doc_id is not null").distinct())
    # the least id of each fingerprint; a fingerprint of very many rows is aggregated before it is shuffled, and its join may be split
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")))
    copies = prints.join(least.where("n > 1").select("fp", "id"), "fp").where("doc_id <> id").select("doc_id", "id")
    found = cut(near_edges(least.where(F.length("fp") == BITS // 8), max_diff, far_diff))
    far = overlapping(found.where("far").select("a", "b"), docs, id_col, text_col)
    edges = found.where("not far").select("a", "b").union(far).union(copies)
    roots = components(edges, "a", "b")
    every = prints.select("doc_id").distinct()
    return every.join(roots, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("group_id"), (F.coalesce("root", "doc_id") == F.col("doc_id")).alias("is_kept")
    )


def dedup(docs: DataFrame, max_diff: int = MAX_DIFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of one document of each group, with all their columns; rows of it that repeat a text come once."""
    g, r, h = fresh(docs, "g", "r", "h")
    ident = F.col(f"`{id_col}`")
    gone = groups(docs, max_diff, id_col, text_col).where("not is_kept").select(F.col("doc_id").alias(g))
    kept = docs.where(ident.isNotNull()).join(gone, ident.cast("bigint") == F.col(g), "left_anti")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    one = Window.partitionBy(ident, h).orderBy(order)
    once = kept.withColumn(h, F.md5(F.col(f"`{text_col}`"))).withColumn(r, F.row_number().over(one)).where(F.col(r) == 1)
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(ident.isNull()))
