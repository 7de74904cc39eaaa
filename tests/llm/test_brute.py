"""Operators that SQL can't express, against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from verbena.llm import licences, mixing, neighbours, packing, passages, quality, simhash, tokens, wrappers
from verbena.llm.common import read

from .helpers import documents, prose, rows

TINY = "/root/testdata/sf0.001"


# ---- repeated passages


def brute_passages(texts, length):
    words = [[w for w in re.split(r"[ \t\r\n]+", t) if w] for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = set()
    for d, w in enumerate(words):
        spans = []
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out |= {(d, *s) for s in spans}
    return out


def test_passages_of_a_table(spark):
    docs = read(spark, TINY, "documents")
    order = docs.orderBy("doc_id").collect()
    expected = {(order[d]["doc_id"], s, e) for d, s, e in brute_passages([r["text"] for r in order], passages.LENGTH)}
    assert {tuple(r) for r in passages.repeated_passages(docs).collect()} == expected and expected


@pytest.mark.parametrize("seed", range(4))
def test_passages_of_few_words(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab" if d % 2 else "abcdefgh") for _ in range(rng.randint(0, 60))) for d in range(12)]
    shared = " ".join(rng.choice("xyz") for _ in range(9))
    texts[3] += " " + shared + " q"
    texts[6] = "r " + shared + "\n" + texts[6]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    expected = brute_passages(texts, 8)
    for hot in (passages.HOT, 3, 0):  # by sorting, by both ways, by grouping only
        assert {tuple(r) for r in passages.repeated_passages(docs, 8, 3, hot=hot).collect()} == expected


def test_passages_with_equal_hashes(spark, monkeypatch):
    """With one hash for all words, only the words themselves tell passages apart: no text is reported that doesn't repeat."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(5)]
    texts += [texts[0], "q " + texts[1][10:] + " r"]
    expected = brute_passages(texts, 8)
    contexts = [passages.contexts([t], 8, 3) for t in texts]
    assert all(len(c[0]) for c in contexts)
    table = []
    for d, (t, (_, _, first, n, off)) in enumerate(zip(texts, contexts)):
        w = t.split()
        table += [(1, d, 0, int((f << 20) | (m << 10) | o), " ".join(w[f : f + m + 7])) for f, m, o in zip(first, n, off)]
    monkeypatch.setattr(passages, "hash_spans", lambda buf, start, end: np.full(len(start), 7, np.uint64))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in table]) for i in range(5)], names=["k", "id", "v", "place", "words"])
    (out,) = passages._compare(8)(iter([batch]))
    got = Counter()
    for d, _, s, e in zip(*(out.column(i).to_pylist() for i in range(4))):
        got.update((d, x) for x in range(s, e))
    assert set(got) == {(d, x) for d, s, e in expected for x in range(s, e)}


def test_suffix_sort_and_collisions():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 12))) for _ in range(30)]
    s = passages.Suffixes(texts, 4)
    words = [t.split() for t in texts]
    starts = [(d, i) for d, w in enumerate(words) for i in range(len(w) - 3)]
    p = np.array([s.base[d] + i for d, i in starts])
    group = np.array([d % 3 for d, _ in starts])
    seen = Counter((d % 3, *words[d][i : i + 4]) for d, i in starts)
    expected = {s.base[d] + i for d, i in starts if seen[d % 3, *words[d][i : i + 4]] > 1}
    assert set(s.repeated(p, group).tolist()) == expected
    sorted_p, index = s.sort(p, group)
    keys = [(g, *s.hashes[q : q + 4].tolist()) for g, q in zip(index, sorted_p)]
    assert keys == sorted(keys)
    # all words with one hash: only the verification tells them apart
    s.hashes[:] = 7
    s.q = passages.prefixes(s.hashes)
    assert set(s.repeated(p, group).tolist()) == expected


# ---- near duplicates


def test_fingerprint_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (40, 4), np.uint64)
    fp = np.repeat(base, 8, axis=0)
    for i in range(len(fp)):
        for b in rng.choice(256, rng.integers(0, 40), replace=False):
            fp[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = fp[simhash.gray_order(fp)]
    got = {(i, j) for a, b in simhash.near_pairs(fp, 30, 512) for i, j in zip(a.tolist(), b.tolist())}
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    assert got == {(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if d[i, j] <= 30}


def test_forests():
    """Joining as the walk goes gives the components of all near pairs, and a large group isn't compared pair by pair."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, (60, 4), np.uint64)
    fp = np.repeat(base, 20, axis=0)
    for i in range(len(fp)):
        for b in rng.choice(256, rng.integers(0, 25), replace=False):
            fp[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    fp = fp[simhash.gray_order(fp)]
    root = np.arange(len(fp))
    for a, b in simhash.near_pairs(fp, 30):
        for i, j in zip(a, b):
            root[root == max(root[i], root[j])] = min(root[i], root[j])
    assert (simhash._forest(fp, 30) == root).all()
    many = np.repeat(base[:1], 60_000, axis=0)
    at = np.arange(len(many))
    many[at, at % 4] ^= np.uint64(1) << (at // 4 % 64).astype(np.uint64)
    many[:, 3] ^= (at % 7).astype(np.uint64)
    assert (simhash._forest(many[simhash.gray_order(many)], 30) == 0).all()


def test_gray_order():
    values = np.arange(64, dtype=np.uint64)
    order = values[simhash.gray_order(np.stack([values ^ (values >> np.uint64(1)), values * 0], axis=1))]
    assert order.tolist() == list(range(64))


def test_near_groups_recall(spark):
    docs = read(spark, TINY, "documents")
    order = [r for r in docs.orderBy("doc_id").collect()]
    fp, has = simhash.fingerprints([r["text"] for r in order])
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    root = list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(order)), 2):
        if has[i] and has[j] and d[i, j] <= simhash.MAX_DIFF:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    expected = {order[i]["doc_id"]: order[find(i)]["doc_id"] for i in range(len(order))}
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs).collect()}
    pairs = {k for k in expected if expected[k] != k}
    assert all(got[k] in (k, expected[k]) for k in got)
    assert sum(got[k] == expected[k] for k in pairs) >= 0.9 * len(pairs)
    kept = {r["doc_id"] for r in simhash.dedup(docs).collect()}
    assert kept == {k for k in got if got[k] == k}


def test_copies_and_clean_documents(spark):
    texts = [prose(i, 120) for i in range(30)]
    rng = random.Random(9)
    near = []
    for t in texts[:10]:
        w = t.split()
        for _ in range(4):
            w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    docs = documents(spark, [(i, t, "s") for i, t in enumerate([*texts, *texts[:5], *near])])
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs).collect()}
    assert all(got[30 + i] == i for i in range(5)) and all(got[35 + i] == i for i in range(10))
    assert all(got[i] == i for i in range(30))


# ---- licences


def naive_statistics(templates, sequence):
    """The longest suffix of each prefix that is in a template."""
    out = []
    for i in range(len(sequence)):
        n = 0
        while n <= i and any(tuple(sequence[i - n : i + 1]) == tuple(t[k : k + n + 1]) for t in templates for k in range(len(t) - n)):
            n += 1
        out.append(n)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=5), st.lists(st.integers(0, 4), max_size=30))
def test_matching_statistics(templates, sequence):
    automaton = licences.Automaton()
    for k, t in enumerate(templates):
        automaton.insert(t, k)
    got = list(automaton.statistics(sequence))
    assert [n for _, n in got] == naive_statistics(templates, sequence)
    for i, (state, n) in enumerate(got):
        if n:
            piece = sequence[i - n + 1 : i + 1]
            expected = sorted((k, e) for k, t in enumerate(templates) for e in range(n, len(t) + 1) if t[e - n : e] == piece)
            assert automaton.occurrences(state) == expected


def test_licences(spark):
    mit = licences.TEXTS["MIT"][0]
    cut = mit.split()
    texts = [
        "some text\nReleased under the MIT License.\nmore text released under the mit license", "Licensed under CC BY-NC 4.0.", prose(1, 200), mit.replace("merge", "blend"),
        " ".join(cut[: len(cut) // 3]), "This work is licensed under the GNU General Public License, version 3.", "the license of the work", "under the terms of the",
    ]
    got = [tuple(r) for r in licences.scan(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id", "start_word").collect()]
    assert [(r[0], r[1]) for r in got] == [(0, "MIT"), (0, "MIT"), (1, "CC-BY-NC-4.0"), (3, "MIT"), (5, "GPL-3.0")]
    assert got[0][2:] == (2, 7, 5, 1.0) and got[1][2:4] == (9, 14)
    assert 0.75 <= got[3][5] < 1
    with pytest.raises(ValueError):
        licences.MAX_TOKENS, old = 10, licences.MAX_TOKENS
        try:
            licences.scan(documents(spark, []))
        finally:
            licences.MAX_TOKENS = old


def test_chains():
    assert licences.chain([(0, 0, 5), (7, 6, 5)], 12) == [(0, 12, 10)]
    assert licences.chain([(0, 0, 5), (50, 6, 5)], 12) == [(0, 5, 5), (50, 55, 5)]
    assert licences.chain([(0, 6, 5), (7, 0, 5)], 12) == [(0, 5, 5), (7, 12, 5)]
    assert licences.chain([(0, 0, 5), (4, 4, 5)], 12) == [(0, 9, 9)]


# ---- nearest neighbours


@pytest.mark.parametrize(("block", "stripe"), [(7, 2), (4096, 8), (50, 1)])
def test_neighbours(spark, block, stripe):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)).astype(np.float32)
    x[60:70] = x[0:10]
    x[3] *= 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {(r["vec_id"], r["rank"]): r["neighbor_id"] for r in neighbours.knn(df, 4, block, stripe).collect()}
    y = x.astype(np.float64)
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    for i in range(120):
        order = sorted((d[i, j], j) for j in range(120) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [j for _, j in order]
    # the stated queries only, in several stripes of them
    some = {(r["vec_id"], r["rank"]): r["neighbor_id"] for r in neighbours.knn(df, 4, block, stripe, every=3, query_stripe=2).collect()}
    assert some == {key: j for key, j in got.items() if key[0] % 3 == 0}


def test_error_bounds():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(50, 1500)), rng.normal(size=(40, 1500)) * 3
    ca, sa, na, ea = neighbours.quantise(a)
    cb, sb, nb, eb = neighbours.quantise(b)
    ints = neighbours.products(ca, cb)
    assert (ints == ca.astype(np.int64) @ cb.astype(np.int64).T).all()
    bound = na[:, None] * eb + ea[:, None] * (nb + eb)
    assert (np.abs(a @ b.T - ints * sa[:, None] * sb) <= bound + 1e-9).all()


# ---- token counts


def unigram_proto(sentinel=-40000.0):
    """The vocabulary file as a unigram model; its sentinel score of -1e9 would cost the library's single precision."""
    import struct

    b = bytearray(open(tokens.VOCABULARY, "rb").read())

    def varint(i):
        v = s = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << s
            s += 7
            if c < 128:
                return v, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        n, i = varint(i)
        j = i
        while key >> 3 == 2 and j < i + n:
            k, j = varint(j)
            if k & 7 == 0:
                if k >> 3 == 3:
                    b[j] = 1
                _, j = varint(j)
            elif k & 7 == 2:
                m, j = varint(j)
                j += m
            else:
                j += 4 if k & 7 == 5 else 8
        i += n
    return bytes(b).replace(b"\x15" + struct.pack("<f", -1e9), b"\x15" + struct.pack("<f", sentinel))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=unigram_proto())


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary()


def test_counts_are_the_librarys(spark, library, vocabulary):
    docs = read(spark, TINY, "documents")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs).collect()}
    rows_ = docs.collect()
    model = tokens.Unigram({p: max(s, -40000.0) for p, s in vocabulary.pieces.items()})
    own = model.counts([r["text"] for r in rows_])
    assert own.tolist() == [len(x) for x in library.encode([r["text"] for r in rows_])]
    # the sentinel pieces (runs of spaces) lose either way
    assert [got[r["doc_id"]] for r in rows_] == own.tolist()


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abthein  ▁\n\té€😀.,", max_size=30))
def test_odd_texts(library, vocabulary, text):
    model = tokens.Unigram({p: max(s, -40000.0) for p, s in vocabulary.pieces.items()})
    assert model.counts([text])[0] == len(library.encode(text))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(alphabet="ab▁", min_size=1, max_size=3), st.sampled_from([-1.0, -2.0, -2.5, -0.1]), min_size=1, max_size=8), st.text(alphabet="abc ", max_size=9))
def test_ties(pieces, text):
    """All segmentations: the best score; by the tie rule, the choice at each end is the earliest start."""
    model = tokens.Unigram(pieces)
    s = "▁" + text.replace(" ", "▁") if text else ""
    best = {0: (0, 0)}
    for end in range(1, len(s) + 1):
        options = []
        for start in range(end):
            p = s[start:end]
            if p in model.scores:
                options.append((best[start][0] + model.scores[p], best[start][1] + 1))
            elif len(p) == 1:
                options.append((best[start][0] + model.unknown_score, best[start][1] + len(p.encode())))
        best[end] = max(options, key=lambda o: o[0])
    assert model.counts([text])[0] == best[len(s)][1]


# ---- wrappers


def page(title, items, extra="", tail="(c) same"):
    return f"<html><h1>{title}</h1><ul>{''.join(f'<li><a href=x>{i}</a></li>' for i in items)}</ul>{extra}<footer>{tail}</footer></html>"


def test_wrapper_of_a_host(spark):
    pages = [
        (1, "http://h.org/1", page("one", ["a", "b", "c"])), (2, "http://h.org/2", page("two", ["d"])),
        (3, "http://H.org/3", page("three", ["e", "f"], "<!-- x --><p>note</p>")), (4, "http://other.org/", page("four", ["g"])),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["host"]: r["wrapper"] for r in wrappers.wrappers(df).collect()}
    assert got["h.org"] == "<html> <h1> #PCDATA </h1> <ul> (<li> <a> #PCDATA </a> </li>)+ </ul> (<p> #PCDATA </p>)? <footer> TEXT </footer> </html>"
    out = {r["page_id"]: r for r in wrappers.extract(df).collect()}
    assert out[1]["texts"] == ["one", "a", "b", "c"] and out[1]["slots"] == [0, 1, 1, 1]
    assert out[3]["texts"] == ["three", "e", "f", "note"] and out[3]["slots"] == [0, 1, 1, 2]
    assert out[2]["slots"] == [0, 1] and out[4]["texts"] == ["four", "g", "(c) same"]


@pytest.mark.parametrize("structures", [wrappers.STRUCTURES, 2, 1])
def test_wrappers_match_their_pages(spark, structures):
    """Every page's stream is in the language of its host's wrapper, read as a regular expression; and no text is lost.

    Also where a host's structures are dealt to several tasks.
    """
    pages = read(spark, TINY.replace("0.001", "0.01"), "pages")
    found = {r["host"]: r["wrapper"] for r in wrappers.wrappers(pages, structures=structures).collect()}
    texts = {r["page_id"]: r["texts"] for r in wrappers.extract(pages, structures=structures).collect()}
    constants, by_host = 0, defaultdict(list)
    for r in pages.collect():
        stream = wrappers.tokens(r["html"])
        host = re.match(wrappers.HOST, r["url"]).group(1).lower()
        pattern = re.sub(r"#PCDATA|TEXT", "#", found[host])
        parts = re.findall(r"<[^>]*>|#|\(|\)[+?]", pattern)
        regex = "".join("(?:" if p == "(" else p if p[0] == ")" else re.escape(p + ";") for p in parts)
        assert re.fullmatch(regex, "".join(s + ";" for s, _ in stream))
        own = [t for _, t in stream if t is not None]
        left = iter(own)
        assert all(t in left for t in texts[r["page_id"]])
        constants += len(own) - len(texts[r["page_id"]])
        by_host[host].append((stream, texts[r["page_id"]], own))
    # texts that are left out stand on at least two different pages of the host
    for pages_ in by_host.values():
        shared = Counter(t for own in {tuple(o) for _, _, o in pages_} for t in set(own))
        for _, kept, own in pages_:
            assert all(shared[t] > 1 for t in (Counter(own) - Counter(kept)))
    assert constants > 0


def test_pages_without_anything_in_common():
    wrapper, slots = wrappers.infer([("<p> #", 2, [0], [1]), ("<b> # <i>", 1, [0], [1])])
    assert wrapper == "(<p>)? (<b>)? #PCDATA (<i>)?" and slots == [[0], [0]]
    wrapper, _ = wrappers.infer([("<p>", 2, [], []), ("<b>", 1, [], [])])
    assert wrapper == "(<p>)? (<b>)?"


def test_nested_repeats():
    symbols = wrappers.Symbols()
    stream = [s for s, _ in wrappers.tokens("<b>1</b><i>2</i><i>3</i><b>4</b><i>5</i>")]
    text, place = wrappers.structure("".join(symbols.char(s) for s in stream), symbols)
    assert text in ("<b> # </b> (<i> # </i>)+ <b> # </b> <i> # </i>",) and place == [0, 1, 1, 2, 3]


def read_structure(html):
    symbols = wrappers.Symbols()
    return wrappers.structure("".join(symbols.char(s) for s, _ in wrappers.tokens(html)), symbols)


def test_nested_lists():
    """Inner repeats become groups before the outer one, at any depth and of any length."""
    inner = "".join(f"<b>{i}</b>" for i in range(3))
    text, place = read_structure(f"<ul><li>{inner}</li><li><b>1</b><b>2</b></li></ul>")
    assert text == "<ul> (<li> (<b> # </b>)+ </li>)+ </ul>" and place == [0] * 5
    deep = "x"
    for k in range(8):
        deep = f"<d{k}>{deep}</d{k}>" * 2
    assert read_structure(deep)[0] == "".join(f"(<d{k}> " for k in range(7, -1, -1)) + "#" + "".join(f" </d{k}>)+" for k in range(8))
    long = "".join(f"<t{k}>" for k in range(300))
    assert read_structure(long * 3 + "<p>x")[0].count("<t0>") == 1


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40))
def test_shortest_period(s):
    expected = next((p for p in range(1, len(s) // 2 + 1) if any(s[i : i + p] == s[i + p : i + 2 * p] for i in range(len(s) - 2 * p + 1))), 0)
    assert wrappers.shortest_period(s) == expected
    short, wrappers.SHORT = wrappers.SHORT, 0
    try:
        assert wrappers.shortest_period(s) == expected
    finally:
        wrappers.SHORT = short


def in_language(wrapper, stream):
    parts = re.findall(r"<[^>]*>|#|\(|\)[+?]", re.sub(r"#PCDATA|TEXT", "#", wrapper))
    return re.fullmatch("".join("(?:" if p == "(" else p if p[0] == ")" else re.escape(p + ";") for p in parts), "".join(s + ";" for s in stream))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<a>", "<b>", "<c>", "#"]), min_size=1, max_size=8), min_size=1, max_size=6), st.integers(1, 4))
def test_joined_wrappers(streams, parts):
    """Whatever is dealt to whichever part, the joined wrapper matches every stream, and each text has one place."""
    made = {}
    for stream in streams:
        symbols = wrappers.Symbols()
        text, place = wrappers.structure("".join(symbols.char(s) for s in stream), symbols)
        n = max(place, default=-1) + 1
        made[text] = (text, 1, list(range(n)), list(range(n)))
    dealt = [list(made.values())[k::parts] for k in range(parts)]
    rows_ = []
    for own in filter(None, dealt):
        wrapper, known, places = wrappers.partial(own)
        assert all(len(p) == len(set(p)) == len(s[2]) for p, s in zip(places, own))
        rows_.append(([x for x, _, _ in wrapper.items], [g for _, g, _ in wrapper.items], [i for _, _, i in wrapper.items], known))
    wrapper, known, ways = wrappers.joined(rows_)
    text, slots = wrappers.written(wrapper, known)
    assert all(in_language(text, stream) for stream in streams)
    for (_, _, _, known_), way in zip(rows_, ways):
        assert len(set(way.values())) == len(way) and set(known_) <= set(way) and set(way.values()) <= set(slots)


def test_hosts_of_copies(spark):
    """Copies of one page are no template; a text that two different pages share is."""
    one, other = "<h1>t</h1><p>one</p>", "<h1>t</h1><p>two</p>"
    data = [(1, "http://a.org/", one), (2, "http://a.org/2", one), (3, "http://b.org/", one), (4, "http://c.org/", one), (5, "http://c.org/", one), (6, "http://c.org/", other)]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").repartition(4)
    out = {r["page_id"]: r["texts"] for r in wrappers.extract(df).collect()}
    assert out == {1: ["t", "one"], 2: ["t", "one"], 3: ["t", "one"], 4: ["one"], 5: ["one"], 6: ["two"]}


# ---- packing, mixing, quality


def brute_best_fit(sizes, capacity):
    """Plain best-fit decreasing: the number of sequences."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 30))
def test_sweeps(sizes, capacity):
    runs, opened = packing.sweep(dict(Counter(sizes)), capacity)
    placed = Counter()
    used = defaultdict(list)
    for size, rank, n, seq, offset in runs:
        for i in range(n):
            placed[size] += 1
            used[seq + i].append((offset, size))
    assert placed == Counter(sizes)
    for pieces in used.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    assert len(used) <= opened
    if sizes:
        assert len(used) <= 1.25 * brute_best_fit(sizes, capacity) + 1


def test_packing_loses_nothing(spark):
    docs = read(spark, TINY, "documents")
    out = packing.pack(docs, 128).collect()
    words = {r["doc_id"]: len(re.findall(r"[^ \t\r\n]+", r["text"])) for r in docs.collect()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        if r["seq_id"] is not None:
            seqs[r["seq_id"]].append((r["seq_offset"], r["n_tokens"]))
    for d, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == words[d]
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 128
    assert set(pieces) == set(words)


def test_mixing_shares(spark):
    docs = documents(spark, [(i, prose(i, 50), "abc"[min(i % 10, 2)]) for i in range(300)])
    plan = mixing.schedule(docs, {"a": 2, "b": 1, "c": 1}, block_tokens=100).collect()
    slots = {}
    for r in plan:
        slots.setdefault(r["slot"], r["source"])
    share = Counter(slots.values())
    assert abs(share["a"] / len(slots) - 0.5) < 0.05
    assert {r["doc_id"] for r in plan} == set(range(300))
    assert mixing.mix(docs, weights={"a": 1}).select("source").distinct().collect()[0][0] == "a"


@pytest.mark.parametrize("tiny", [0.00001, 0.1, 1e-9])
def test_tiny_sources(spark, tiny):
    """A source of next to no weight comes whole, and the others aren't repeated without end for it."""
    docs = documents(spark, [(i, prose(i, 50), "abcde"[i % 5]) for i in range(100)])
    plan = mixing.schedule(docs, {"a": tiny, "b": 1000.0, "c": 1000.0, "d": 1000.0, "e": 1000.0}, block_tokens=100).collect()
    assert {r["doc_id"] for r in plan} == set(range(100))
    assert max(r["slot"] for r in plan) <= (mixing.REPEAT + 4) * 50
    two = documents(spark, [(1, prose(1, 50), "big"), (2, prose(2, 40), "tiny")])
    assert {r["doc_id"] for r in mixing.schedule(two, {"big": 1000.0, "tiny": tiny}).collect()} == {1, 2}
    assert {r["source"] for r in mixing.schedule(two, {"big": 1.0, "tiny": 0.0}).collect()} == {"big"}


def test_large_weights(spark):
    """Sources of 1e12 tokens beside one of one token: intervals, lengths and points without overflow."""
    intervals = mixing._slots_of("1"), mixing.ONE
    assert intervals == ("least(3 * 1, 1 + 64)", 2**32)
    ids = [1, 2, 65535, 65536, 2**31 + 12345, 2**32 - 1]
    point = mixing.point(F.col("id"))
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select(point).collect()]
    assert got == [i * mixing.PHI % 2**32 for i in ids]
    per = spark.createDataFrame([("one", 1), *((f"s{i}", 10**12) for i in range(10))], "source string, tokens bigint").selectExpr("*", "cast(floor(sqrt(tokens) * 1024) as bigint) as w")
    marks = mixing.intervals(per, mixing.BLOCK_TOKENS).collect()
    total = sum(r["blocks"] for r in marks)
    assert max(r["need"] * mixing.ONE // (r["hi"] - r["lo"]) for r in marks) <= (mixing.REPEAT + 4) * total
    assert min(r["hi"] - r["lo"] for r in marks) >= 1 and max(r["hi"] for r in marks) <= mixing.ONE


def test_quality_policies(spark):
    docs = documents(spark, [(0, prose(0, 100), "s"), (1, "", "s"), (2, "word " * 100, "s"), (3, prose(3, 50) + " you stupid idiot", "s"), (4, "## %% ## %% " * 20, "s")])
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    assert got[0]["fail_bits"] == 0 and got[1]["fail_bits"] == quality.BIT["empty"]
    assert got[2]["fail_bits"] & quality.BIT["repeated_words"] and got[3]["fail_bits"] & quality.BIT["abuse"]
    assert got[3]["keep_v1"] and not got[3]["keep_v3"]
    assert [r["doc_id"] for r in quality.apply_policy(docs).collect()] == [0]
    ablation = {(r["policy"], r["rule"]): r for r in quality.ablation(quality.ledger(docs)).collect()}
    assert ablation["v3", "empty"]["n_only"] == 1 and ablation["v3", "empty"]["n_kept_without"] == 2


# ---- the pipeline


def test_pipeline_by_hand(spark):
    """run() against the stages by brute force: the rules by Python, lines by Python, groups by all pairs."""
    docs = read(spark, TINY, "documents")
    kept = quality.apply_policy(docs).collect()
    ledger = {r["doc_id"]: r["keep_v3"] for r in quality.ledger(docs).collect()}
    assert {r["doc_id"] for r in kept} == {d for d, k in ledger.items() if k}
    norm = lambda line: re.sub(r"[ \t\r]+", " ", line.lower()).strip(" ")
    held = Counter(n for r in kept for n in {norm(x) for x in r["text"].split("\n")} if n)
    texts = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not norm(x) or held[norm(x)] < 10) for r in kept}
    deduped = corpus_pipeline.line_dedup(spark, quality.apply_policy(docs), TINY)
    assert {r["doc_id"]: r["text"] for r in deduped.collect()} == texts
    ids = sorted(texts)
    fp, has = simhash.fingerprints([texts[i] for i in ids])
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    single = {ids[i] for i in range(len(ids)) if not any(i != j and has[i] and has[j] and d[i, j] <= simhash.MAX_DIFF for j in range(len(ids)))}
    final = corpus_pipeline.run(spark, TINY).collect()
    got = {r["doc_id"] for r in final}
    assert single <= got <= set(texts)
    for r in final:
        assert r["doc_tokens"] == len(re.findall(r"[^ \t\r\n]+", texts[r["doc_id"]]))
    copies = defaultdict(int)
    for r in final:
        copies[r["doc_id"], r["copy"]] += r["n_tokens"]
    assert all(n == len(re.findall(r"[^ \t\r\n]+", texts[i])) for (i, _), n in copies.items())


@pytest.mark.parametrize("name", ["op1_quality_ledger", "quality_ablation", "op3_nearest_neighbours", "op8_line_dedup", "op10_source_schedule"])
def test_against_sql(spark, name):
    import duckdb

    from verbena.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    out = queries.QUERIES[name](spark, TINY)
    assert rows(out.select(*names)) == sorted(cur.fetchall(), key=repr)
