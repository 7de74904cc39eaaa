import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.operators import clustering as C
from verbena.operators import vectors as G
from verbena.operators.graph import components

TEXTS = ["hello good help", "hi good help", "good help hi", "hi good help", "thank you", "thank you much", "thank you thank", "thank you", "have problem", "have problem", "problem have", "have problem"]


def blobs(spark, noise=()):
    rng = np.random.default_rng(5)
    centres = np.array([[0.2, 0.9, 0.1], [0.6, 0.1, 0.5], [0.8, 0.7, -0.6]])
    x = np.repeat(centres, 4, axis=0) + rng.normal(0, 0.03, (12, 3))
    x = np.vstack([x, *[np.array([n]) for n in noise]])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")


def labels(df):
    return {r["id"]: r["label"] for r in df.collect()}


def brute_dbscan(x, eps, least):
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = d.sum(1) >= least
    out, k = [-1] * len(x), 0
    for s in range(len(x)):
        if out[s] != -1 or not core[s]:
            continue
        stack = [s]
        while stack:
            i = stack.pop()
            if out[i] != -1:
                continue
            out[i] = k
            if core[i]:
                stack += [j for j in np.flatnonzero(d[i]) if out[j] == -1]
        k += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_dbscan_is_the_sequential_one(spark, seed):
    x = np.random.default_rng(seed).normal(size=(60, 2))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    got = labels(C.dbscan(v, 0.4, 4))
    assert [got[i] for i in range(60)] == brute_dbscan(x, 0.4, 4)


def test_dbscan_of_nothing(spark):
    empty = spark.createDataFrame([], "id bigint, v array<double>")
    assert C.dbscan(empty, 1, 2).count() == 0
    with pytest.raises(ValueError):
        G.within(empty, 1, "other")


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7)], "i bigint, j bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(4, 3), (5, 3), (9, 8)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "i bigint, j bigint")
    assert components(chain).where("root = 0").count() == 200


def test_grid_is_independent_of_blocks(spark):
    x = np.random.default_rng(3).normal(size=(50, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    expected = {(i, int(j)) for i in range(50) for j in np.argsort(-sim[i])[:5]}
    for rows in (7, 4096):
        assert {(r["i"], r["j"]) for r in G.top_k(v, 5, rows).collect()} == expected


def test_silhouette_and_deviation(spark):
    x, df = blobs(spark)
    own = np.repeat([0, 1, -1], 4)
    points = df.select("id", F.col("embedding").alias("v")).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(own)], "id bigint, label int"), "id")
    got = {r["id"]: r for r in C.silhouette(points).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for i in range(12):
        a = d[i, own == own[i]].sum() / 3
        b = min(d[i, own == c].mean() for c in set(own) - {own[i]})
        assert np.isclose(got[i]["silhouette"], (b - a) / max(a, b))
        m = d[np.ix_(own == own[i], own == own[i])]
        assert np.isclose(got[i]["deviation"], 0 if own[i] == -1 else -(d[i, own == own[i]].mean() - m.mean() - m.var()))


def test_gaps_and_merging(spark):
    rows = spark.createDataFrame([(0, 6), (1, 3), (2, -1), (3, 3)], "id bigint, label int")
    assert labels(C.fill_gaps(rows)) == {0: 1, 1: 0, 2: -1, 3: 0}
    x, df = blobs(spark)
    split = df.select("id", F.col("embedding").alias("v"), (F.col("id").cast("int") / 2).cast("int").alias("label"))
    merged = labels(C.merge_clusters(split, 0.1))
    assert [merged[i] for i in range(12)] == [0] * 4 + [1] * 4 + [2] * 4
    assert labels(C.merge_clusters(split, 0)) == {i: i // 2 for i in range(12)}
    assert C.merge_plan([0, 1, 2], np.array([[0, 0.1, 9], [0.1, 0, 0.1], [9, 0.1, 0]]), 0.5) == [(1, 0), (0, 1), (2, 1)]


@pytest.mark.parametrize("algorithm", ["dbscan", "optics"])
@pytest.mark.parametrize("kind", [C.IDensity, C.StepsDensity])
def test_density(spark, kind, algorithm):
    _, df = blobs(spark, noise=[[-0.9, -0.9, 0.1]])
    extra = {"samples_early_stop": 3} if kind is C.StepsDensity else {}
    model = kind(initial_max_distance=0.3, initial_minimum_samples=3, max_iteration=2, algorithm=algorithm, **extra)
    got = labels(model.fit_predict(df))
    groups = [{got[i] for i in range(k, k + 4)} for k in (0, 4, 8)]
    assert all(len(g) == 1 and -1 not in g for g in groups) and len(set.union(*groups)) == 3 and got[12] == -1
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "noise"])], "id bigint, text string")
    topics = {r["id"]: r["topic"] for r in model.get_topics(texts).collect()}
    assert topics[0] == "good help hi" and topics[4] == "thank you" and topics[8] == "have problem" and topics[12] == "Unlabelled"


def test_guards(spark):
    with pytest.raises(ValueError):
        C.IDensity(algorithm="kmeans")
    with pytest.raises(KeyError):
        C.IDensity().get_topics(spark.createDataFrame([], "id bigint, text string"))
    rows = spark.createDataFrame([(0, -1, "a b")], "id bigint, label int, text string")
    assert C.topics(rows).first()["topic"] == "Unlabelled"


def test_topic_options(spark):
    """Stop words, n-grams and bounds of the document frequency, by hand."""
    from verbena.operators.tfidf import topic_terms

    rows = [("a", "red hot iron the iron"), ("a", "red hot"), ("b", "red ice the"), ("c", "the cold ice")]
    df = spark.createDataFrame(rows, "label string, text string")
    found = lambda **o: {(r["label"], r["term"]): r["tf"] for r in topic_terms(df, "label", "text", **o).collect()}
    assert found(stop_words=("the",)) == {("a", "red"): 2, ("a", "hot"): 2, ("a", "iron"): 2, ("b", "red"): 1, ("b", "ice"): 1, ("c", "cold"): 1, ("c", "ice"): 1}
    assert found(stop_words=("the",), ngram_range=(2, 2)) == {("a", "red hot"): 2, ("a", "hot iron"): 1, ("a", "iron iron"): 1, ("b", "red ice"): 1, ("c", "cold ice"): 1}
    assert found(min_df=2) == {("a", "red"): 2, ("b", "red"): 1, ("b", "ice"): 1, ("c", "ice"): 1, ("a", "the"): 1, ("b", "the"): 1, ("c", "the"): 1}
    assert ("a", "the") not in found(max_df=0.9) and ("a", "red") in found(max_df=0.9)
