r"""HTML extraction by wrappers, inferred as union-free regular expressions.

A page is a stream of tokens: tags (name, class and id) and texts; comments, scripts and styles are
skipped. Within a page, adjacent equal blocks of tags and texts become a repeated group
``( ... )+``, innermost first: those of the shortest period there is, until there is none. The pages of a host are then aligned one structure after another
(the commonest first) with the host's wrapper: a block that another page repeats is read as that
group, stretches that only one side has become optional groups ``( ... )?``, and a text position
at which the pages differ is a slot ``#PCDATA``; texts that several different pages share stay as
constants of the template. Copies of one page (equal structure and texts) count as one page. The result is a union-free expression that matches all pages of the host, and the
slots' texts, in order, are the page's content.

Pages themselves are not shuffled for the inference: a page sends its structure, counted with those
of its map task, and the least and greatest hash of each text position. Up to ``structures`` distinct
structures of a host are one task; more are dealt to as many tasks by a hash, whose wrappers are then
aligned with one another in the same way (what is optional in one is optional in the result). For the extraction, pages meet their structure's slots in a join on host and structure.

Defined cases: a null or empty page, or one without any text, comes out with no slots; a null url,
or one without a host, has the empty host; a host with one page, or with copies of one page only, has a wrapper of slots only; markup that is
not closed is read as it stands, an unfinished tag to the end of the page; repeated rows and rows
of one page_id are pages of their own; an empty table gives an empty result; further columns are
ignored. Blocks of any length and depth are looked for as repeats.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import POWERS, hash_spans, keep, mix64, prefixes

#: Streams of more items have the periods of their repeats found by hashes and not by expressions; either finds the same.
SHORT = 2048
#: Distinct structures of a host in one task; structures that a map task holds before it sends them.
STRUCTURES = 2000
HELD = 20_000
TEXT = "#"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_VALUE, _QUOTES = re.compile(r"[^\w-]+"), "\"'"
_SPACE = re.compile(r"\s+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def tokens(page: str | None) -> list[tuple[str, str | None]]:
    """(symbol, text) of each token: a tag has no text, and a text has the symbol ``TEXT``."""
    out: list[tuple[str, str | None]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                out.append((TEXT, text))
            held.clear()

    for m in _TOKEN.finditer(page or ""):
        name = m.group(3)
        if name:
            flush()
            attributes = "".join(f" {k.lower()}={_VALUE.sub('_', v.strip(_QUOTES))}" for k, v in _ATTRIBUTE.findall(m.group(4))) if m.group(4) else ""
            out.append((f"<{m.group(2)}{name.lower()}{attributes}>", None))
        elif m.group()[0] != "<" or m.group() == "<":
            held.append(m.group())
        else:
            flush()
    flush()
    return out


class Symbols:
    """Characters for tokens and groups, so that expressions over token streams are expressions over strings."""

    def __init__(self) -> None:
        self.code: dict[str, str] = {}
        self.name: dict[str, str] = {}

    def char(self, name: str) -> str:
        c = self.code.get(name)
        if c is None:
            at = len(self.code)
            c = self.code[name] = chr(0x20 + at if at < 0xD000 else 0x10000 + at - 0xD000)
            self.name[c] = name
        return c

    def group(self, block: str) -> str:
        return self.char("(" + " ".join(self.name[c] for c in block) + ")+")


@lru_cache(4096)
def _tandem(period: int) -> re.Pattern:
    """Adjacent equal blocks of a length."""
    return re.compile(rf"(.{{{period}}})\1+", re.S)


_SQUARE = re.compile(r"(.+?)\1", re.S)


def shortest_period(s: str) -> int:
    """The least length of a block that stands twice in a row in ``s``; 0 if none does."""
    if len(s) <= SHORT:
        some = _SQUARE.search(s)
        most = len(some.group(1)) if some else 0
        return next((p for p in range(1, most) if _tandem(p).search(s)), most)
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    q = prefixes(mix64(codes.astype(np.uint64) + np.uint64(1)))
    _, down = POWERS.upto(n + 1)

    def same(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (q[a + size] - q[a]) * down[a] == (q[b + size] - q[b]) * down[b]

    for p in range(1, n // 2 + 1):
        # a block twice in a row covers a multiple of p: how far both its sides agree there, forwards and backwards
        i = np.arange(0, n - p, p)
        i = i[codes[i] == codes[i + p]]
        if not len(i):
            continue
        ahead, back = np.ones(len(i), np.int64), np.zeros(len(i), np.int64)
        for found, most, way in ((ahead, np.minimum(p, n - p - i), 0), (back, np.minimum(p - 1, i), 1)):
            high = most.copy()
            for _ in range(int(p).bit_length()):
                mid = (found + high + 1) >> 1
                ok = same(i - mid * way, i + p - mid * way, mid)
                found[:], high = np.where(ok, mid, found), np.where(ok, high, mid - 1)
        if (ahead + back >= p).any() and _tandem(p).search(s):
            return p
    return 0


def structure(stream: str, symbols: Symbols) -> tuple[str, list[int]]:
    """The structure of a stream, adjacent equal blocks as groups, and for each text token the number of its text position in it."""
    text = symbols.char(TEXT)
    # each item: its symbol, its number of text positions, and (token, position in the item) of its texts
    items = [(c, 1, [(i, 0)]) if c == text else (c, 0, []) for i, c in enumerate(stream)]
    while period := shortest_period(symbols_ := "".join(x[0] for x in items)):
        out, at = [], 0
        for m in _tandem(period).finditer(symbols_):
            block = m.group(1)
            out += items[at : m.start()]
            at = m.end()
            width = sum(n for _, n, _ in items[m.start() : m.start() + len(block)])
            own, base = [], 0
            for j, (_, n, texts) in enumerate(items[m.start() : at]):
                base = base if j % len(block) else 0
                own += [(i, base + k) for i, k in texts]
                base += n
            group = block if len(block) == 1 and symbols.name[block][0] == "(" else symbols.group(block)
            out.append((group, width, own))
        items = out + items[at:]
    place: dict[int, int] = {}
    base = 0
    for _, n, own in items:
        place.update((i, base + k) for i, k in own)
        base += n
    return " ".join(symbols.name[c] for c, _, _ in items), [place[i] for i in sorted(place)]


_ITEM = re.compile(r"<[^>]*>|#|\(|\)\+")


def items_of(text: str) -> list[str]:
    """The top-level items of a structure."""
    out, depth, held = [], 0, []
    for m in _ITEM.finditer(text):
        t = m.group()
        depth += (t == "(") - (t == ")+")
        held.append(t)
        if not depth:
            out.append(_joined(held))
            held = []
    return out


def _joined(parts: list[str]) -> str:
    return " ".join(parts).replace("( ", "(").replace(" )+", ")+")


def regroup(items: list[str], blocks: list[tuple[tuple[str, ...], str]]) -> list[tuple[str, int]]:
    """Read single occurrences of blocks that other pages repeat as those groups: (item, number of its text positions)."""
    starts: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for block, name in blocks:
        starts.setdefault(block[0], []).append((block, name))
    out, i = [], 0
    while i < len(items):
        for block, name in starts.get(items[i], ()):
            if tuple(items[i : i + len(block)]) == block:
                out.append((name, name.count(TEXT)))
                i += len(block)
                break
        else:
            out.append((items[i], items[i].count(TEXT)))
            i += 1
    return out


class Wrapper:
    """A wrapper: a sequence of items [item, number of the optional group it is in (None: mandatory), id]."""

    def __init__(self) -> None:
        self.items: list[list] = []
        self.ids = 0
        self.empty = True

    def align(self, items: list[str], groups: list[int | None] | None = None) -> list[int]:
        """Generalise the wrapper so that it also matches the items (those of an optional group: all or none of them); the ids of the wrapper's items they fall on.

        What only one side has becomes optional. Neighbours stay in one group if they were in the same group, or in none, on both sides.
        """
        groups = groups or [None] * len(items)
        if self.empty:
            self.items, self.empty = [[x, g, i] for i, (x, g) in enumerate(zip(items, groups))], False
            self.ids = len(items)
            return list(range(len(items)))
        out, merged, pairs, i, j = [], [], [], 0, 0
        for a, b, n in SequenceMatcher(None, [x[0] for x in self.items], items, autojunk=False).get_matching_blocks():
            for x in self.items[i:a]:
                merged.append(x)
                pairs.append((x[1], "absent"))
            for x, g in zip(items[j:b], groups[j:b]):
                merged.append([x, None, self.ids])
                pairs.append(("absent", g))
                out.append(self.ids)
                self.ids += 1
            for x, g in zip(self.items[a : a + n], groups[b : b + n]):
                merged.append(x)
                pairs.append((x[1], g))
                out.append(x[2])
            i, j = a + n, b + n
        group = 0
        for k, (x, pair) in enumerate(zip(merged, pairs)):
            group += k > 0 and pair != pairs[k - 1]
            x[1] = None if pair == (None, None) else group
        self.items = merged
        return out


def _groups(name: str) -> list[str]:
    """The groups within an item, itself included."""
    out, stack = [], []
    for i, c in enumerate(name):
        if c == "(":
            stack.append(i)
        elif c == ")" and stack:
            out.append(name[stack.pop() : i + 2])
    return out


def partial(structures: list[tuple[str, int, list[int], list[int]]]) -> tuple[Wrapper, dict, list[list[tuple[int, int]]]]:
    """The wrapper of some of a host's (structure, different pages, least hashes, greatest hashes) rows, what is known of its text positions, and the positions of each structure's texts.

    A text position is (id of an item, number within it); it is known by [different pages, least hash, greatest hash].
    """
    split = [items_of(s[0]) for s in structures]
    blocks = _blocks(split)
    wrapper, known, places = Wrapper(), {}, []
    for items, (_, pages, lows, highs) in zip(split, structures):
        read = regroup(items, blocks)
        ids = wrapper.align([x for x, _ in read])
        own = [(i, k) for i, (_, n) in zip(ids, read) for k in range(n)]
        for p, low, high in zip(own, lows, highs):
            _know(known, p, [pages, low, high])
        places.append(own)
    return wrapper, known, places


def _blocks(sequences: list[list[str]]) -> list[tuple[tuple[str, ...], str]]:
    """(block, group) of all groups in sequences of items, longer blocks first."""
    names = {name for items in sequences for x in items for name in _groups(x)}
    return sorted(((tuple(items_of(name[1:-2])), name) for name in names), key=lambda x: (-len(x[0]), x[1]))


def _know(known: dict, p, new: list[int]) -> None:
    old = known.get(p)
    known[p] = new if old is None else [old[0] + new[0], min(old[1], new[1]), max(old[2], new[2])]


def joined(parts: list[tuple[list[str], list[int | None], list[int], dict]]) -> tuple[Wrapper, dict, list[dict]]:
    """One wrapper of partial ones (items, groups, ids, known), what is known of it, and where the text positions of each part went."""
    wrapper, known, maps = Wrapper(), {}, []
    blocks = _blocks([items for items, *_ in parts])
    for items, groups, ids, own in parts:
        at, new_items, new_groups, moved = 0, [], [], []
        for name, _ in regroup(items, blocks):
            size = 1 if items[at] == name else len(items_of(name[1:-2]))
            held = groups[at : at + size]
            # a block of which a page may have a part isn't read as the group
            whole = [(name, slice(at, at + size))] if all(g == held[0] for g in held) else [(items[k], slice(k, k + 1)) for k in range(at, at + size)]
            for x, span in whole:
                new_items.append(x)
                new_groups.append(groups[span][0])
                moved.append([(i, k) for y, i in zip(items[span], ids[span]) for k in range(y.count(TEXT))])
            at += size
        way = {old: (i, k) for i, olds in zip(wrapper.align(new_items, new_groups), moved) for k, old in enumerate(olds)}
        for p, new in own.items():
            _know(known, way[p], new)
        maps.append(way)
    return wrapper, known, maps


def written(wrapper: Wrapper, known: dict) -> tuple[str, dict[tuple[int, int], int]]:
    """The expression of a wrapper, and the slot of each text position (-1: constant)."""
    slots: dict[tuple[int, int], int] = {}
    parts, group, number = [], None, 0
    for x, g, i in wrapper.items:
        k = -1

        def named(_m: re.Match) -> str:
            nonlocal k, number
            k += 1
            pages, low, high = known.get((i, k), (0, 0, 0))
            if pages > 1 and low == high:
                slots[i, k] = -1
                return "TEXT"
            slots[i, k] = number
            number += 1
            return "#PCDATA"

        if g != group and group is not None:
            parts.append(")?")
        if g != group and g is not None:
            parts.append("(")
        group = g
        parts.append(re.sub(r"(?<![^ (])#(?![^ )])", named, x))
    if group is not None:
        parts.append(")?")
    return _joined(parts).replace(" )?", ")?"), slots


def infer(structures: list[tuple[str, int, list[int], list[int]]]) -> tuple[str, list[list[int]]]:
    """The wrapper of (structure, different pages, least hashes, greatest hashes) rows of one host, and each structure's slots by text position (-1: constant)."""
    wrapper, known, places = partial(structures)
    text, slots = written(wrapper, known)
    return text, [[slots.get(p, -1) for p in own] for own in places]


def _parsed(pages: list[str | None]) -> Iterator[tuple[str, list[int], list[str]]]:
    """(structure, text position of each text, texts) of pages."""
    symbols = Symbols()
    for p in pages:
        stream = tokens(p)
        if len(symbols.code) > 50_000:
            symbols = Symbols()
        text, place = structure("".join(symbols.char(s) for s, _ in stream), symbols)
        yield text, place, [t for _, t in stream if t is not None]


def _text_hashes(texts: list[str]) -> np.ndarray:
    data = [t.encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    end = np.cumsum(size)
    return hash_spans(np.frombuffer(b"".join(data), np.uint8), end - size, end).view(np.int64) if len(data) else np.zeros(0, np.int64)


def _page_hash(hashes: np.ndarray) -> int:
    return int(mix64(prefixes(hashes.view(np.uint64))[-1:]).view(np.int64)[0])


def _structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, structure, pages, least, greatest, low, high), one for each host and structure of a map task: of the pages' hashes, and of the texts' by position."""
    found: dict[tuple[str, str], list] = {}
    for b in batches:
        for host, (text, place, texts) in zip(b.column(1).to_pylist(), _parsed(b.column(2).to_pylist())):
            if not place:
                continue
            h, at = _text_hashes(texts), np.array(place)
            low, high = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, at, h)
            np.maximum.at(high, at, h)
            page = _page_hash(h)
            _merge(found, (host, text), [1, page, page, low, high])
        if len(found) > HELD:
            yield _found_rows(found)
            found = {}
    if found:
        yield _found_rows(found)


def _found_rows(found: dict) -> pa.RecordBatch:
    keys = list(found)
    cols = [[k[0] for k in keys], [k[1] for k in keys], *[[found[k][i] for k in keys] for i in range(3)], *[[found[k][i].tolist() for k in keys] for i in (3, 4)]]
    types = (pa.string(), pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names=["host", "structure", "pages", "least", "greatest", "low", "high"])


def _merge(found: dict, key, new: list) -> None:
    old = found.get(key)
    found[key] = new if old is None else [old[0] + new[0], min(old[1], new[1]), max(old[2], new[2]), np.minimum(old[3], new[3]), np.maximum(old[4], new[4])]


_PART = "host string, bucket bigint, key bigint, positions array<int>, items array<string>, groups array<int>, ids array<int>, pages array<bigint>, low array<bigint>, high array<bigint>"
_PART_SCHEMA = pa.schema(
    [("host", pa.string()), ("bucket", pa.int64()), ("key", pa.int64()), ("positions", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
    + [(c, pa.list_(pa.int32())) for c in ("groups", "ids")] + [(c, pa.list_(pa.int64())) for c in ("pages", "low", "high")]
)


def _partial_wrapper(t: pa.Table) -> pa.Table:
    """The structures of a bucket of a host -> a row for each (key, positions), numbers into the bucket's text positions, and one for its wrapper."""
    merged: dict[str, list] = {}
    for text, pages, least, greatest, low, high in zip(*(t.column(c).to_pylist() for c in ("structure", "pages", "least", "greatest", "low", "high"))):
        _merge(merged, text, [pages, least, greatest, np.array(low), np.array(high)])
    order = sorted(merged, key=lambda s: (-merged[s][0], s))
    # more than one different page is all that counts
    wrapper, known, places = partial([(s, 1 + (merged[s][1] != merged[s][2]), *[x.tolist() for x in merged[s][3:]]) for s in order])
    number = {p: n for n, p in enumerate((i, k) for x, _, i in wrapper.items for k in range(x.count(TEXT)))}
    host, bucket = t.column("host")[0].as_py(), t.column("bucket")[0].as_py()
    rows = [(host, bucket, key, [number[p] for p in own], *[None] * 6) for key, own in zip(_text_hashes(order).tolist(), places)]
    facts = [known[p] for p in number]
    rows.append((host, bucket, None, None, [x for x, _, _ in wrapper.items], [g for _, g, _ in wrapper.items], [i for _, _, i in wrapper.items], *[[f[j] for f in facts] for j in range(3)]))
    return pa.table([list(c) for c in zip(*rows)], schema=_PART_SCHEMA)


def _join_wrappers(t: pa.Table) -> pa.Table:
    """The partial wrappers of a host -> rows (host, bucket, wrapper, slots by the bucket's text positions)."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("bucket", "items", "groups", "ids", "pages", "low", "high"))), key=lambda r: r[0])
    parts, numbers = [], []
    for _, items, groups, ids, pages, low, high in rows:
        places = [(i, k) for x, i in zip(items, ids) for k in range(x.count(TEXT))]
        numbers.append(places)
        parts.append((items, groups, ids, {p: list(f) for p, f in zip(places, zip(pages, low, high))}))
    wrapper, known, ways = joined(parts)
    text, slots = written(wrapper, known)
    by_position = [[slots[way[p]] for p in places] for way, places in zip(ways, numbers)]
    schema = pa.schema([("host", pa.string()), ("bucket", pa.int64()), ("wrapper", pa.string()), ("slots", pa.list_(pa.int32()))])
    host = t.column("host")[0].as_py()
    return pa.table([[host] * len(rows), [r[0] for r in rows], [text] * len(rows), by_position], schema=schema)


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, host, key, positions, texts)."""
    for b in batches:
        parsed = list(_parsed(b.column(2).to_pylist()))
        key = _text_hashes([p[0] for p in parsed])
        cols = [b.column(0), b.column(1), pa.array(key), pa.array([p[1] for p in parsed], pa.list_(pa.int32())), pa.array([p[2] for p in parsed], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "host", "key", "positions", "texts"])


def _base(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), HOST, 1)), F.lit(""))
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))


def _wrapper_rows(base: DataFrame, structures: int = STRUCTURES) -> tuple[DataFrame, DataFrame]:
    """Rows (host, bucket, key, positions) of structures, and (host, bucket, wrapper, slots)."""
    rows = keep(base.mapInArrow(_structures, "host string, structure string, pages bigint, least bigint, greatest bigint, low array<bigint>, high array<bigint>"))
    # a host of very many structures is dealt to tasks, a structure always to the same
    size = rows.groupBy("host").agg(F.approx_count_distinct("structure", 0.02).alias("n")).where(F.col("n") > structures).select(F.col("host").alias("h"), F.expr(f"n div {structures} + 1").alias("buckets"))
    dealt = rows.join(size, F.col("host") == F.col("h"), "left").withColumn("bucket", F.coalesce(F.pmod(F.xxhash64("structure"), F.col("buckets")), F.lit(0)).cast("bigint")).drop("h", "buckets")
    parts = keep(dealt.groupBy("host", "bucket").applyInArrow(_partial_wrapper, _PART))
    whole = parts.where("items is not null").select("host", "bucket", "items", "groups", "ids", "pages", "low", "high")
    return parts.where("items is null").select("host", "bucket", "key", "positions"), whole.groupBy("host").applyInArrow(_join_wrappers, "host string, bucket bigint, wrapper string, slots array<int>")


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structures: int = STRUCTURES) -> DataFrame:
    """Rows (host, wrapper), one a host that has any text."""
    return _wrapper_rows(_base(pages, id_col, url_col, html_col), structures)[1].select("host", "wrapper").distinct()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structures: int = STRUCTURES) -> DataFrame:
    """Rows (page_id, host, slots, texts), one a page: the slot number and text of its variable texts, in page order."""
    base = _base(pages, id_col, url_col, html_col)
    places, slots = _wrapper_rows(base, structures)
    named = places.join(slots.select(F.col("host").alias("sh"), F.col("bucket").alias("sb"), "slots"), (F.col("host") == F.col("sh")) & (F.col("bucket") == F.col("sb")))
    plans = keep(named.select(F.col("host").alias("h"), F.col("key").alias("k"), F.transform("positions", lambda p: F.get("slots", p)).alias("by_position")))
    kind = base.schema["page_id"].dataType.simpleString()
    texts = base.mapInArrow(_page_texts, f"page_id {kind}, host string, key bigint, positions array<int>, texts array<string>")
    met = texts.join(plans, (F.col("host") == F.col("h")) & (F.col("key") == F.col("k")), "left")
    pairs = F.arrays_zip(F.transform("positions", lambda p: F.get("by_position", p)).alias("slot"), F.col("texts").alias("text"))
    met = met.select("page_id", "host", F.filter(pairs, lambda x: x["slot"] >= 0).alias("kept"))
    return met.select("page_id", "host", F.coalesce(F.col("kept.slot"), F.array().cast("array<int>")).alias("slots"), F.coalesce(F.col("kept.text"), F.array().cast("array<string>")).alias("texts"))
