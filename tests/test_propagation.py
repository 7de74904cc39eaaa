import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.operators import propagation as P
from verbena.operators.adapters import HashingEncoder
from verbena.operators.vectors import normalised


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id bigint, embedding array<double>, label int")


def test_expander(spark):
    x = np.array([[1, 1.1, 1], [1, 1, 1.1], [1.05, 1, 1], [-1, -1, -1.1], [-1.1, -1, -1], [-1, -1.1, -1], [-1, 1, 1.1], [-1.1, 1, 1], [-1, 1.1, 1]])
    fitted = P.LabelExpander(0.5, 3).fit(table(spark, x, [0, 0, 0, 1, 1, 1, 2, 2, 2]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r["label"]: r["centroid"] for r in fitted.table.collect()}
    assert all(np.allclose(got[c], unit[3 * c : 3 * c + 3].mean(0)) for c in range(3))
    test = np.array([[1.02, 1.02, 1.02], [-1.03, -1.03, -1.03], [-1.03, 1.03, 1.03], [1, -1, 0.2]])
    rows = {r["id"]: r["label"] for r in fitted.transform(table(spark, test, [0] * 4)).collect()}
    assert rows == {0: 0, 1: 1, 2: 2, 3: -1}
    with pytest.raises(KeyError):
        P.LabelExpander().transform(table(spark, test, [0] * 4))


def test_propagation_is_numpys(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) + np.repeat(np.eye(6)[:2] * 3, 20, axis=0)
    y = np.where(np.arange(40) % 5 == 0, np.repeat([0, 1], 20), -1)
    points = normalised(table(spark, x, y), "id", "embedding", ("label",))
    edges = P.degree_normalised(P.symmetrised(P.knn_graph(points, 5)))
    z = {r["id"]: r["z"] for r in P.diffuse(points.select("id", "label"), edges, 2, max_iterations=200, tolerance=1e-10).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -9)
    w = np.zeros((40, 40))
    for i in range(40):
        for j in np.argsort(-sim[i])[:5]:
            w[i, j] = sim[i, j] ** 3
    w = w + w.T
    d = w.sum(1)
    d[d == 0] = 1
    wn = w / np.sqrt(np.outer(d, d))
    for c in range(2):
        b = np.where(y == c, 1 / (y == c).sum(), 0)
        exact = np.linalg.solve(np.eye(40) - 0.99 * wn, b)
        assert np.allclose([z[i][c] for i in range(40)], exact, atol=1e-5)
    out = {r["id"]: r for r in P.propagate(points, 2, 5).collect()}
    assert all(out[i]["label"] == y[i] and out[i]["weight"] == 1 for i in range(40) if y[i] >= 0)
    assert np.mean([out[i]["label"] == i // 20 for i in range(40)]) > 0.9


def test_steps():
    assert P.expansion_steps(10, 20, 2, "linear") == [21, 30]
    assert P.expansion_steps(10, 20, 2, "exponential") == [14, 30]
    with pytest.raises(ValueError):
        P.expansion_steps(10, 20, 2, "other")


def test_selection(spark):
    rows = spark.createDataFrame([(i, i % 2, w) for i, w in enumerate([0.9, 0.1, 0.9, 0.5, 0.9, 0.7])], "id bigint, label int, weight double")
    got = {r["id"]: r["label"] for r in P.select_top(rows, 2).collect()}
    assert got == {0: 0, 1: -1, 2: 0, 3: -1, 4: -1, 5: -1}
    gold = rows.where("id < 2").select("id", "label")
    got = {r["id"]: r["label"] for r in P.select_stratified(rows, gold, 4).collect()}
    assert got == {0: 0, 1: -1, 2: 0, 3: 1, 4: -1, 5: 1}


def test_weights(spark):
    rows = spark.createDataFrame([(0,), (0,), (1,)], "label int")
    assert {r["label"]: r["weight"] for r in P.class_weights(rows, 3).collect()} == {0: 0.5, 1: 1.0, 2: 0.0}
    with pytest.raises(ValueError):
        P.pseudo_labels(rows, rows, 1)


@pytest.mark.parametrize(("policy", "dist", "ratios"), [("exponential", "top", [14 / 30, 1.0]), ("linear", "stratified", [None, 1.0])])
def test_rounds(spark, policy, dist, ratios):
    texts = [f"{w} {w} word{i}" for w in ("apple", "river") for i in range(15)]
    y = [(i // 15 if i % 3 == 0 else -1) for i in range(30)]
    docs = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, y))], "id bigint, text string, label int")
    losses, seen = [], []
    model = P.Propagator(2, HashingEncoder(32), lambda rows, w: losses.append(rows.count()) or 0.5, 5, expansion_policy=policy, dist_policy=dist, callbacks=[seen.append])
    history = model.fit(docs)
    assert len(history) == len(seen) == 2 and len(losses) == 4
    assert history[-1]["ratio_labelled"] == 1.0 and np.isclose(history[0]["pct_change"], 1 - 10 / 30)
    if ratios[0]:
        assert np.isclose(history[0]["ratio_labelled"], ratios[0])
    assert model.labels.where(F.col("label") == -1).count() == 0
