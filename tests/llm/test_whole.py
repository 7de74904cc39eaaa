"""Cases in which an operator once did less than its whole job."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from verbena.llm import groupcount, lines, quality, simhash
from verbena.llm.common import read
from verbena.plans import registry

from .helpers import documents, prose


# ---- copies of a whole text


def test_a_copied_text_stays_once(spark, tmp_path):
    """Twelve copies of one text (two differ in case and white space) keep their lines, and one copy goes through all stages."""
    text = "\n".join(prose(100 + i, 12) for i in range(6))
    copies = [text] * 10 + [text.upper(), "\n" + text.replace("\n", " \n\n\t") + "\n "]
    rest = [f"{prose(200 + i, 40)}\nRead our terms of use before you go on." for i in range(15)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate([*copies, *rest])])
    got = {r["doc_id"]: r["text"] for r in lines.drop_common_lines(docs, by_content=True).collect()}
    assert [got[i] for i in range(12)] == copies
    assert [got[12 + i] for i in range(15)] == [t.split("\n")[0] for t in rest]
    docs.where("doc_id <> 10").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    final = [r for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["doc_id"] < 12]
    assert {r["doc_id"] for r in final} == {0} and {r["doc_tokens"] for r in final} == {72}


def test_copies_of_one_id_or_of_none(spark):
    """By content too, rows of one doc_id or without one are one document for the count."""
    rows = [(1, f"{prose(i, 5)}\nshared", "s") for i in range(12)] + [(None, f"{prose(50 + i, 5)}\nshared", "s") for i in range(12)]
    docs = documents(spark, rows)
    assert all(r["text"].endswith("shared") for r in lines.drop_common_lines(docs, by_content=True).collect())


# ---- near copies of short texts


def shingles(text):
    w = text.split()
    return set(zip(w, w[1:], w[2:]))


def test_near_copies_by_length(spark):
    """Copies with a 3-word-shingle overlap of just 0.5, by the length of the text; clean texts of one length stay apart."""
    rng, texts, of = random.Random(5), [], {}
    for n in (20, 40, 60, 120, 240):
        for k in range(40):
            w = prose(1000 * n + k, n).split()
            of[len(texts)] = n
            texts.append(" ".join(w))
            changed = list(w)
            for at in range(4, n - 3, 9):
                new = changed[:at] + ["new%d" % rng.randrange(10**6)] + changed[at + 1 :]
                if 2 * len(shingles(" ".join(new)) & shingles(texts[-1])) < len(shingles(" ".join(new)) | shingles(texts[-1])):
                    break
                changed = new
            texts.append(" ".join(changed))
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["group_id"] for r in simhash.groups(docs).collect()}
    for n in (20, 40, 60, 120, 240):
        assert sum(got[i + 1] == i for i in of if of[i] == n) >= 0.9 * 40, n
    assert all(got[i] == i for i in of)


def test_pairs_at_the_limit_meet():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**64, (4000, 4), np.uint64)
    b = a.copy()
    for x in b:
        for k in rng.choice(256, simhash.FAR_DIFF, replace=False):
            x[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    assert (simhash.band_keys(a) == simhash.band_keys(b)).any(axis=1).mean() >= 0.89


@pytest.mark.parametrize("small, group", [(4096, 1 << 19), (100, 1 << 19), (100, 700)])
def test_no_pair_within_the_limits_is_lost(spark, monkeypatch, small, group):
    """All pairs at the limits and below, against brute force: by the walk, by blocks of bits, and by blocks over several groups."""
    monkeypatch.setattr(simhash, "SMALL", small, raising=False)
    monkeypatch.setattr(simhash, "LEAST", group, raising=False)
    monkeypatch.setattr(simhash, "GROUP", group, raising=False)
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 2**64, (2000, 4), np.uint64)
    fp[1000:1800] = fp[:800]
    for k, x in enumerate(fp[1000:1800]):
        for b in rng.choice(256, (simhash.FAR_DIFF, simhash.FAR_DIFF - 1, simhash.MAX_DIFF, simhash.MAX_DIFF + 1, 3)[k % 5], replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    # a large group of copies, and one whose bits are mostly zeros
    fp[1800:1900] = fp[1800] ^ (np.uint64(1) << rng.integers(0, 64, (100, 4), np.uint64))
    fp[1900:] = np.uint64(1) << rng.integers(0, 64, (100, 4), np.uint64)
    fp = np.unique(fp, axis=0)
    ids = rng.permutation(len(fp)) * 7 - 3000
    distinct = spark.createDataFrame([(int(i), x.tobytes()) for i, x in zip(ids, fp)], "id bigint, fp binary")
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2)
    i, j = np.nonzero(np.triu(d <= simhash.FAR_DIFF, 1))
    root = np.arange(len(fp))
    near = d[i, j] <= simhash.MAX_DIFF
    simhash._join(root, i[near], j[near])
    far = {tuple(sorted((int(ids[a]), int(ids[b])))) for a, b in zip(i, j) if root[a] != root[b]}
    got = simhash.near_edges(distinct).collect()
    at = {int(x): k for k, x in enumerate(ids)}
    edges = np.array([(at[r["a"]], at[r["b"]]) for r in got if not r["far"]])
    found = np.arange(len(fp))
    simhash._join(found, edges[:, 0], edges[:, 1])
    assert (found == root).all() and len(far) > 250
    assert {(r["a"], r["b"]) for r in got if r["far"] and root[at[r["a"]]] != root[at[r["b"]]]} == far


def test_limits_of_parts():
    """Bits that differ in each part by more than its share differ in all by more than the limit."""
    for limit in range(70):
        words = simhash.shares(limit, 4)
        assert sum(x + 1 for x in words) == limit + 1 and all(sum(x + 1 for x in simhash.shares(w, 4)) == w + 1 for w in words if w >= 0)


def test_a_ninth_of_the_pairs_is_reached():
    """Of random fingerprints, the blocks of all words together let about 0.11 of the pairs have a word compared."""
    words = simhash.shares(simhash.FAR_DIFF, 4)
    reached = sum(sum(len(m) for m in simhash._masks(radius)) for w in words for radius in simhash.shares(w, 4)) / 2**16
    assert reached < 1 / 9


def test_joined_copies_are_passed_over(monkeypatch):
    """In a large group of near copies, few of all pairs have their fingerprints compared."""
    rng = np.random.default_rng(13)
    fp = rng.integers(0, 2**64, (7000, 4), np.uint64)
    fp[:6000] = fp[0]
    for x in fp[:6000]:
        for b in rng.choice(256, 14, replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    looked, alike = [0], simhash._alike

    def counted(fp, i, j):
        looked[0] += len(i)
        return alike(fp, i, j)

    monkeypatch.setattr(simhash, "_alike", counted)
    for word in range(4):
        root, i, _ = simhash.word_edges(fp, len(fp), word, simhash.MAX_DIFF, simhash.FAR_DIFF)
        assert (root[:6000] == 0).all() and (root[6000:] == np.arange(6000, 7000)).all() and not len(i)
    assert looked[0] < 4 * 50 * len(fp)


def test_far_pairs_need_common_words(spark):
    """Of pairs in the far range, those without enough common words stay apart."""
    docs = documents(spark, [(1, "a b c d e f g h", "s"), (2, "a b c d e f g x", "s"), (3, "a b p q r s t u", "s"), (4, None, "s")])
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a bigint, b bigint")
    assert [tuple(r) for r in simhash.overlapping(pairs, docs).collect()] == [(1, 2)]


def test_only_words_in_reach_are_compared(monkeypatch):
    """With full nodes, no more words are compared than the blocks in reach of each other have: none to fill up rows."""
    rng = np.random.default_rng(14)
    n = 1 << 18
    fp = rng.integers(0, 2**64, (2 * n, 4), np.uint64)
    compared, xor = [0], np.bitwise_xor

    def counted(x, y, out):
        compared[0] += out.size
        return xor(x, y, out=out)

    monkeypatch.setattr(np, "bitwise_xor", counted)
    simhash.word_edges(fp, n, 3, simhash.MAX_DIFF, simhash.FAR_DIFF)
    reach = sum(sum(len(m) for m in simhash._masks(radius)) for radius in simhash.shares(simhash.shares(simhash.FAR_DIFF, 4)[3], 4)) / 2**16
    assert 0.95 * reach < compared[0] / n**2 < 1.05 * reach


def test_words_of_far_pairs_go_to_cells(spark, monkeypatch):
    """Over many cells the overlapping pairs are those of brute force, also of an id with two texts; words are joined to cells and not to every pair."""
    monkeypatch.setattr(simhash, "PAIRS", 40, raising=False)
    monkeypatch.setattr(simhash, "TEXTS", 16, raising=False)
    rng = random.Random(15)
    texts = [(i % 39, " ".join(rng.sample("abcdefghij", rng.randrange(1, 10)))) for i in range(40)] + [(39, None), (40, "a")]
    of = {}
    for i, t in texts:
        of.setdefault(i, []).append(set((t or "").split()))
    every = [(a, b) for a in range(41) for b in range(a + 1, 41)]
    near = lambda x, y: bool(x & y) and len(x & y) >= simhash.OVERLAP * len(x | y)
    want = {(a, b) for a, b in every if any(near(x, y) for x in of[a] for y in of[b])}
    got = simhash.overlapping(spark.createDataFrame(every, "a bigint, b bigint"), documents(spark, [(i, t, "s") for i, t in texts]))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 40
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


# ---- groups of documents that have a line


@pytest.mark.parametrize("rows, prefix", [(1 << 19, 4096), (1 << 19, 12), (0, 4096)])
def test_lines_are_counted_by_groups_without_all_pairs(spark, monkeypatch, rows, prefix):
    """Near and far copies, chains of them, ids of several texts, none, and texts without words: the lines of the full search, which only what stays open needs."""
    rng = random.Random(16)
    bodies, of = [], []
    for k in range(150):
        chain = [prose(3000 + k, 50).split()]
        for _ in range(rng.choice((0, 0, 1, 3, 9))):
            new = list(rng.choice(chain))
            for _ in range(rng.choice((1, 3, 6, 9))):
                new[rng.randrange(50)] = "w%d" % rng.randrange(10**6)
            chain.append(new)
        of += [k] * len(chain)
        bodies += [" ".join(w) for w in chain]
    held = [[] for _ in bodies]
    for k in range(60):
        some = rng.sample(range(150), rng.choice((4, 7, 9, 10, 11, 30)))
        for i, x in enumerate(of):
            if x in some and rng.random() < 0.8:
                held[i].append(f"l{k}.")
    table = [(i, "\n".join([x, *held[i]])) for i, x in enumerate(bodies)]
    table += [(i + 1, table[i][1]) for i in range(0, 60, 7)]
    table += [(None, f"{prose(k, 9)}\nl{k}.\nl{k}.") for k in range(0, 60, 5)]
    table += [(10_000 + k % 14, "\n".join(["!?!", "-" * (k % 14)] + ["??"] * (k % 14 < 9))) for k in range(20)]
    docs = documents(spark, [(i, x, "s") for i, x in table]).persist()
    want = lines.drop_common_lines(docs, groups=simhash.groups(docs)).select("doc_id", "text")
    by_ids = lines.drop_common_lines(docs).select("doc_id", "text")
    assert by_ids.exceptAll(want).count() > 50 and docs.select("doc_id", "text").exceptAll(want).count() > 50
    full, groups = [], simhash.groups
    monkeypatch.setattr(simhash, "groups", lambda *a, **k: full.append(1) or groups(*a, **k))
    monkeypatch.setattr(groupcount, "ROWS", rows)
    monkeypatch.setattr(groupcount, "HELD", prefix)
    got = corpus_pipeline.line_dedup(spark, docs, "").select("doc_id", "text")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert rows == 0 or prefix < 64 or not full
    assert rows or full
    docs.unpersist()


# ---- abuse in all languages


def test_learned_terms_of_every_language(spark):
    """Terms of one half of the labelled rows, on the other half: recall by language and false hits."""
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    terms = quality.abuse_terms(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("lang", "toxic", quality.has_terms(docs["text"], terms).alias("hit"))
    every, hits = Counter(), Counter()
    for r in held.collect():
        every[r["lang"], r["toxic"]] += 1
        hits[r["lang"], r["toxic"]] += r["hit"]
    print({k: (hits[k], every[k]) for k in sorted(every)})
    for lang in ("en", "fr", "de", "es"):
        assert hits[lang, 1] >= 0.75 * every[lang, 1] > 0, lang
        assert hits[lang, 0] <= 0.04 * every[lang, 0], lang


def test_learned_bit(spark, tmp_path):
    bad = [f"{prose(i, 40)} vilainmot" for i in range(6)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate([*bad, *(prose(100 + i, 40) for i in range(6)), None])])
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i < 6)) for i in range(12) if i != 5], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    terms = quality.abuse_terms(docs, labels)
    assert (0, "vilainmot") in terms
    rows = {r["doc_id"]: r for r in quality.learned_ledger(docs, [(0, "vilainmot")]).collect()}
    assert [bool(rows[i]["fail_bits"] & quality.LEARNED) for i in range(13)] == [True] * 6 + [False] * 7
    assert rows[5]["keep_v3"] and not rows[5]["keep_learned"] and rows[7]["keep_learned"]
    kept = {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert not kept & set(range(6))


def test_a_long_text_stays(spark):
    """A clean text of over a million words has its bit and stays in production."""
    docs = documents(spark, [(1, prose(1, 5000), "s"), (2, " ".join(str_word(i) for i in range(1_000_001)), "s")])
    ledger = {r["doc_id"]: r["fail_bits"] for r in quality.ledger(docs).collect()}
    assert ledger == {1: 0, 2: quality.BIT["too_long"]}
    assert {r["doc_id"] for r in quality.apply_policy(docs).collect()} == {1, 2}


def str_word(i):
    return "".join("abcdefghij"[int(c)] for c in f"{i:07d}")


# ---- registered parameters


class Recorded(Exception):
    pass


def recorder(*args, **kwargs):
    raise Recorded(kwargs)


def test_synonyms_train_with_the_defaults(spark, monkeypatch):
    monkeypatch.setattr(registry.augmentation, "word_vectors", recorder)
    with pytest.raises(Recorded) as e:
        registry.QUERIES["augment_synonyms"](spark, "/root/testdata/sf0.001")
    assert e.value.args[0].get("size", 300) == 300 and e.value.args[0].get("min_count", 1) == 1


def test_stepwise_density_has_five_rounds(spark, monkeypatch):
    monkeypatch.setattr(registry.clustering, "StepsDensity", recorder)
    with pytest.raises(Recorded) as e:
        registry.QUERIES["stepwise_density"](spark, "/root/testdata/sf0.001")
    assert e.value.args[0]["max_iteration"] == 5
