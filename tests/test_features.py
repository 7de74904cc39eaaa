import numpy as np
import pytest
from pyspark.sql import functions as F

from verbena.errors import NotFitted
from verbena.functions import vectors as V
from verbena.operators.adapters import HashingEncoder
from verbena.operators.features import BagOfPOS, EncoderFeatures, KeyWords, LdaTopics
from verbena.operators.pipeline import Pipeline
from verbena.sources.io import from_texts


@pytest.fixture(scope="module")
def corpus(spark):
    three = ["test sentence test spend cap keywords text cap", "second test sentence spend cap testing", "test said capitan new cap little cap"]
    two = ["fourth example repeated words like dog dog dog dog dog dog", "sample duplicated words like cat cat cat cat cat cat"]
    return from_texts(spark, three * 30 + two * 30).cache()


def test_keywords(corpus):
    model = KeyWords(3, "binary", ["cap", "spend cap"])
    got = {r["doc_id"]: r["features"] for r in model.fit_transform(corpus).collect()}
    assert len(got[0]) == len(model.top_keyword_vocab) + 2 == 14
    assert "cap" not in model.top_keyword_vocab and "spend cap" not in model.top_keyword_vocab
    assert set(got[0]) <= {0.0, 1.0}
    counted = KeyWords(3, "count", ["cap", "spend cap"]).fit_transform(corpus).where("doc_id = 0").first()["features"]
    assert max(counted) <= 1
    # a key word of several words matches inside words: "spend cap" in "spend capitan"
    one = KeyWords(1, "binary", ["spend cap"]).fit(corpus)
    assert one.transform(from_texts(corpus.sparkSession, ["spend capitan"])).first()["features"][-1] == 1.0


def test_keywords_brute_force(corpus):
    from collections import Counter

    texts = [r["text"].split() for r in corpus.collect()]
    expected = []
    for n in (1, 2, 3, 4):
        c = Counter(" ".join(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))
        expected += [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5]]
    assert KeyWords(5).fit(corpus).top_keyword_vocab == expected


def test_unfitted(corpus):
    with pytest.raises(NotFitted):
        KeyWords().transform(corpus)
    with pytest.raises(ValueError):
        KeyWords(mode="other")
    with pytest.raises(NotFitted):
        LdaTopics().transform(corpus)


def test_pos(spark):
    annotated = Pipeline().annotate(from_texts(spark, ["the dog quickly runs", "two dogs", ""]))
    model = BagOfPOS("tag").fit(annotated)
    rows = [r["features"] for r in model.transform(annotated).orderBy("doc_id").collect()]
    assert all(len(r) == len(model.feature_names) for r in rows)
    assert np.allclose([np.linalg.norm(r) for r in rows], [1, 1, 0])
    unseen = Pipeline().annotate(from_texts(spark, ["42 ! ?"]))
    assert BagOfPOS("tag").fit(Pipeline().annotate(from_texts(spark, ["dog"]))).transform(unseen).first()["features"] == [0.0]
    assert not set(BagOfPOS("pos").fit(annotated).feature_names) & set(model.feature_names)
    with pytest.raises(ValueError):
        BagOfPOS("other")


def test_lda(corpus):
    model = LdaTopics(3).fit(corpus)
    rows = np.array([r["features"] for r in model.transform(corpus).collect()])
    assert rows.shape == (150, 3) and np.allclose(rows.sum(1), 1)
    tokens = corpus.withColumn("w", F.split("text", " "))
    assert np.allclose(rows, [r["features"] for r in model.transform(tokens, "w").collect()])
    assert model.transform(corpus, refit_idf=True).count() == 150


def test_encoder(spark):
    rows = EncoderFeatures(HashingEncoder(8)).transform(from_texts(spark, ["a b", "", "a b"])).orderBy("doc_id").collect()
    assert rows[0]["features"] == rows[2]["features"] and rows[1]["features"] == [0.0] * 8


def test_pooling(spark):
    states = [[[1.0, 5.0], [3.0, -1.0], [9.0, 9.0]]]
    df = spark.createDataFrame([(states[0], [1, 1, 0])], "s array<array<double>>, m array<int>")
    get = lambda how: df.select(V.pool(F.col("s"), F.col("m"), how)).first()[0]
    assert get("mean") == [2.0, 2.0] and get("max") == [3.0, 5.0] and get("cls") == [1.0, 5.0]
    with pytest.raises(ValueError):
        V.pool(F.col("s"), F.col("m"), "other")


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    row, zero = df.select(V.l2_normalised(F.col("a")), V.l2_normalised(F.col("a"), "null"), V.euclidean(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b"))).collect()
    assert np.allclose(row[0], [0.6, 0.8]) and np.isclose(row[2], np.sqrt(20)) and np.isclose(row[3], 0.4)
    assert zero[0] == [0, 0] and zero[1] is None and zero[3] is None
    with pytest.raises(ValueError):
        V.distance(F.col("a"), F.col("b"), "other")
