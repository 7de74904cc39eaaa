"""Process mining, augmentation, retrieval, learning, sources, streams and the registry."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbena.errors import NoModel
from verbena.operators import augmentation as A
from verbena.operators import learning as L
from verbena.operators import retrieval
from verbena.operators.pipeline import Pipeline
from verbena.operators.process_mining import ProcessMining
from verbena.sources import io
from verbena.streaming import streams


def test_process_mining(spark):
    log = [("a", 2, "y"), ("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "x"), ("d", 1, "x"), ("d", 1, "z")]
    miner = ProcessMining("c", "t", "e", ["e"])
    with pytest.raises(KeyError):
        miner.get_all_paths()
    miner.fit(spark.createDataFrame(log, "c string, t int, e string"))
    assert [(r["path"], r["frequency"]) for r in miner.get_all_paths().collect()] == [(["x"], 0.25), (["x", "z"], 0.25), (["x", "y"], 0.5)]
    assert miner.get_all_paths(False, 2, False).count() == 2
    assert miner.get_probability(["x", "y"]) == 0.5 and miner.get_probability(["y"]) == 0 and miner.get_probability(["x"], False) == 1
    assert {tuple(r) for r in miner.transition_matrix.collect()} == {("x", "y", 2), ("x", "z", 1)}
    with pytest.raises(KeyError):
        miner.get_probability(["q"])
    with pytest.raises(ValueError):
        miner.get_probability([])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


TROUBLED = ["a", "", " ", "12", "!?", "hello world", "Ünïcode tést", "x" * 50]


@pytest.mark.parametrize(("augmenter", "most"), [(A.Switch(2), 4), (A.Replace(2), 2), (A.Insert(2), 2)])
def test_typos(spark, augmenter, most):
    docs = io.from_texts(spark, TROUBLED)
    rows = docs.select("text", augmenter.augment(F.col("text"), F.col("doc_id")).alias("new")).collect()
    for r in rows:
        if len(r["text"]) < 2:
            assert r["new"] == r["text"]
        else:
            assert distance(r["text"].strip(), r["new"].strip()) <= most
            if isinstance(augmenter, A.Switch):
                assert Counter(r["new"].replace(" ", "")) == Counter(r["text"].replace(" ", ""))
            if isinstance(augmenter, A.Insert):
                assert len(r["new"]) == len(r["text"].strip()) + 2
    again = docs.repartition(3).select("text", augmenter.augment(F.col("text"), F.col("doc_id")).alias("new")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_combinations(spark):
    docs = io.from_texts(spark, ["some words here"] * 200)
    never = A.Sequence((A.Insert(1),), (0.0,)).augment(F.col("text"), F.col("doc_id"))
    assert docs.where(never != F.col("text")).count() == 0
    one = A.OneOf((A.Insert(1), A.Insert(0)), (0.3,)).augment(F.col("text"), F.col("doc_id"))
    assert 30 <= docs.where(one != F.col("text")).count() <= 90
    with pytest.raises(ValueError):
        A.Switch(1, 2)
    with pytest.raises(ValueError):
        A.OneOf((A.Insert(1),) * 3, (0.1,))
    assert docs.select(A.Switch(0).augment(F.col("text"), F.col("doc_id"))).first()[0] == "some words here"


def test_back_translation():
    class Fake:
        def translate(self, texts, target):
            return [f"{target}:{t}" for t in texts]

    assert A.BackTranslation("de", Fake()).augment_texts(["x"]) == ["en:de:x"]
    assert A.BackTranslation().augment_texts([]) == []
    with pytest.raises(NoModel):
        A.BackTranslation().augment_texts(["x"])


def test_synonyms(spark, tmp_path):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.9, 0.1]), ("car", [0.0, 1.0])], "word string, vector array<double>")
    io.write_word_vectors(vectors, str(tmp_path / "v"))
    table = A.synonym_table(io.read_word_vectors(spark, str(tmp_path / "v")), 2)
    assert {r["word"]: r["synonyms"] for r in table.collect()}["cat"] == ["cat", "dog"]
    rows = A.replace_synonyms(io.from_texts(spark, ["The cat, the cat", "", "qqq"]), table, 1.0).orderBy("doc_id").collect()
    assert set(rows[0]["text"].split()) <= {"the", "cat", "dog"} and rows[1]["text"] == "" and rows[2]["text"] == "qqq"


def test_balance(spark):
    rows = spark.createDataFrame([(i, f"text {i}", "a" if i < 3 else "b") for i in range(23)], "id bigint, text string, c string")
    got = {r["c"]: r["count"] for r in A.balance(rows, A.Switch(1), 5, 10, ["c"]).groupBy("c").count().collect()}
    assert got == {"a": 5, "b": 10}
    assert A.balance(rows, A.Switch(1)).count() == 23
    assert A.balance(rows, A.Switch(1), 40).count() == 40


def test_bm25_brute_force(spark):
    texts = ["the cat sat", "the dog sat down", "a cat and a dog", "nothing here"]
    docs = io.from_texts(spark, texts)
    queries = spark.createDataFrame([(1, "cat sat"), (2, "dog")], "item_id bigint, text string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(queries, docs, 10).collect()}
    words = [t.split() for t in texts]
    df = Counter(w for t in words for w in set(t))
    idf = {w: math.log(4 - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    avg = sum(map(len, words)) / 4
    for q, text in ((1, "cat sat"), (2, "dog")):
        for d, w in enumerate(words):
            s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in text.split() if t in w)
            assert np.isclose(got.get((q, d), 0), s, atol=1e-6)
    pairs = retrieval.sentence_pairs(spark.createDataFrame([("the cat", "a cat sat", 1.0)], "a string, b string, y double"), "a", "b", "y")
    assert retrieval.silver_pairs(pairs, 3).count() == 2
    split = {r["split"]: r["count"] for r in retrieval.split_80_10_10(spark.range(2000), F.col("id")).groupBy("split").count().collect()}
    assert sum(split.values()) == 2000 and 1500 < split["train"] < 1700


def test_losses():
    z = np.array([[2.0, 1.0, 0.1], [0.0, 0.0, 3.0]])
    y = np.array([0, 2])
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(L.cross_entropy(z, y), -np.log(p[[0, 1], y]))
    assert L.cross_entropy(z, np.array([0, -100]))[1] == 0
    target = np.full((2, 3), 0.05)
    target[[0, 1], y] = 0.9
    assert np.isclose(L.label_smoothing_loss(z, y, 0.1), -(target * np.log(p)).sum())
    assert np.allclose(L.label_smoothing_loss(p, np.eye(3)[y], from_logits=False, reduction="none"), L.cross_entropy(z, y))
    tokens, tags = np.zeros((2, 4, 5)), np.zeros((2, 4), int)
    assert np.allclose(L.multitask_uncertainty((z, tokens), (y, tags)), L.cross_entropy(z, y) + np.log(5))
    assert np.allclose(L.multitask_sigmoid((z, tokens), (y, tags)), 0.5 * L.cross_entropy(z, y) + 0.5 * np.log(5))
    multi = np.array([[1, 0, 1], [0, 1, 0]])
    q = 1 / (1 + np.exp(-z))
    assert np.allclose(L.multilabel_smoothing_loss(z, multi, reduction="none"), -(multi * np.log(q) + (1 - multi) * np.log(1 - q)).mean(1))
    assert L.multilabel_smoothing_loss(z, multi, 0.1) > 0
    with pytest.raises(ValueError):
        L.label_smoothing_loss(z, y, reduction="other")


def test_meter_and_stopping():
    meter = L.AverageMeter()
    for v in (0.1, 0.2):
        meter.update(v, 8)
    assert np.isclose(meter.avg, 0.15) and meter.count == 16
    stop = L.EarlyStopping(2, "min", alpha=0.1)
    assert [stop.update(v) for v in (1.0, 0.95, 0.8, 0.79, 0.78)] == [True, False, True, False, False] and stop.stop


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, predicted int")
    got = {r["label"]: r for r in L.classification_metrics(df).collect()}
    assert np.isclose(got[1]["precision"], 1 / 3) and got[1]["recall"] == 1 and np.isclose(got[0]["f1"], 2 / 3)
    assert got[None]["precision"] == 0.5 and np.isclose(got[None]["f1"], (2 / 3 + 0.5 + 0) / 3)


def test_tags(spark):
    ids, names = L.tag_maps(["PER", "LOC"])
    assert ids == {"O": 0, "BPER": 1, "IPER": 2, "BLOC": 3, "ILOC": 4} and names[4] == "ILOC"
    df = spark.createDataFrame(
        [([(0, 0), (0, 3), (4, 7), (8, 9), (0, 0)], [("PER", 0, 7), ("LOC", 8, 9)])], "o array<struct<start:int,end:int>>, s array<struct<label:string,start:int,end:int>>"
    )
    assert df.select(L.encode_tags(F.col("o"), F.col("s"), ids)).first()[0] == [-100, 1, 2, 3, -100]


def test_datasets(spark):
    df = spark.createDataFrame([(0, 2.0), (0, 1.0), (1, 1.0), (-1, 1.0)], "label int, w double")
    assert {r["label"]: r["share"] for r in L.class_shares(df).collect()} == {0: 2 / 3, 1: 1 / 3}
    rows = L.training_rows(df, "label", "w", L.class_shares(df)).collect()
    assert len(rows) == 3 and np.isclose(max(r["item_weight"] for r in rows), 4 / 3)
    multi = spark.createDataFrame([([1, 0, 1],), ([0, 0, 0],)], "y array<int>")
    assert [r["item_weight"] for r in L.multilabel_rows(multi, "y", [1.0, 5.0, 2.0]).collect()] == [1.5]


def test_gradients():
    rng = np.random.default_rng(0)
    network = L.Network([L.Linear(4, 5, rng), L.LayerNorm(5), L.ReLU(), L.BatchNorm(5), L.Linear(5, 3, rng)])
    x, y, w = rng.normal(size=(6, 4)), np.array([0, 1, 2, 0, 1, 2]), np.ones(6)
    loss, g = L._softmax_loss(network.forward(x, True, rng), y, w)
    for layer in reversed(network.layers):
        g = layer.backward(g)
    for layer in network.layers:
        for k in layer.g:
            flat, grad = layer.p[k].ravel(), layer.g[k].ravel()
            for i in range(0, len(flat), 3):
                old, e = flat[i], 1e-6
                flat[i] = old + e
                up = L._softmax_loss(network.forward(x, True, rng), y, w)[0].mean()
                flat[i] = old - e
                down = L._softmax_loss(network.forward(x, True, rng), y, w)[0].mean()
                flat[i] = old
                assert np.isclose((up - down) / (2 * e), grad[i], atol=1e-6)


def test_networks(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)) + np.repeat(np.eye(8)[:2] * 4, 30, axis=0)
    df = spark.createDataFrame([(i, v.tolist(), i // 30 if i % 5 else -1) for i, v in enumerate(x)], "id bigint, embedding array<double>, label int").coalesce(2)
    model = L.Autoencoder([4, 2], n_epochs=3, batch_size=8)
    out = model.fit_transform(df)
    assert len(out.first()["reduced"]) == 2 and model.history[-1]["val"] > 0
    classifier = L.IntentClassifier(2, n_epochs=5, batch_size=8, lr=1e-2).fit(df)
    got = classifier.predict(df)
    assert got.where((F.col("predicted") == (F.col("id") >= 30).cast("int"))).count() >= 54
    L.save_checkpoint(str(tmp_path / "c"), classifier.network, spark, 4, 0.5)
    other = L.intent_head(8, 2, seed=3)
    assert L.load_checkpoint(str(tmp_path / "c"), other, spark) == {"epoch": 5, "best": 0.5}
    assert np.allclose(other.forward(x), classifier.network.forward(x))
    with pytest.raises(KeyError):
        L.Autoencoder([2]).transform(df)


@pytest.mark.parametrize("shared", [False, True])
def test_joint_network(spark, shared):
    """Gradients against differences, and a small task that both heads learn."""
    rng = np.random.default_rng(2)
    net = L.JointNetwork(3, 2, 3, hidden=4, dropout=0.0, shared=shared)
    rows = pd.DataFrame({"x": [rng.normal(size=(n, 3)).tolist() for n in (2, 3)], "y": [0, 1], "w": [1.0, 2.0], "tags": [[0, 2], [1, -100, 0]]})
    value = lambda: net.losses(rows, "joint", False, rng)[0].mean()
    net.backward(net.losses(rows, "joint", False, rng)[1])
    for layer in net.layers:
        for k, g in {k: np.array(v) for k, v in layer.g.items()}.items():
            at = tuple(0 for _ in g.shape)
            old = layer.p[k].copy()
            layer.p[k][at] += 1e-5
            up = value()
            layer.p[k][at] -= 2e-5
            down = value()
            layer.p[k] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4, (type(layer).__name__, k)
    texts = [(i, [[float(t == 1), float(t == 2), float(i % 2)] for t in own], i % 2, own) for i in range(60) for own in [[(i + j) % 3 for j in range(4)]]]
    df = spark.createDataFrame(texts, "id bigint, states array<array<double>>, label int, tags array<int>").coalesce(2)
    model = (L.IntentClassifierNERShared if shared else L.IntentClassifierNER)(2, 3, hidden=16, batch_size=8, lr=0.02, n_epochs=8).fit(df)
    got = model.predict(df.unionByName(df.limit(1).withColumn("states", F.lit(None).cast("array<array<double>>")))).collect()
    assert sum(r["predicted"] == r["label"] for r in got[:60]) >= 57 and got[60]["predicted"] is None
    assert sum(r["predicted_tags"] == r["tags"] for r in got[:60]) >= 54
    assert len(model.encode(df.withColumn("attention_mask", F.transform("states", lambda _: F.lit(1)))).first()["embedding"]) == 3
    assert isinstance(L.MODELS.build({"class_name": type(model).__name__, "n_intents": 2, "n_ner": 3}), L.IntentClassifierNER)


def test_training_goes_on(spark, tmp_path):
    """A checkpoint has the optimiser's moments; ``unpack`` names what a trainer reads."""
    df = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(20)], "id bigint, embedding array<double>, label int").coalesce(1)
    trainer = L.Trainer(L.intent_head(2, 2, 4), "softmax", batch_size=8, n_epochs=2, schedule=lambda e: 0.5**e)
    assert [h["lr"] for h in trainer.fit(df, "embedding", "label")] == [1e-3, 5e-4]
    trainer.network.losses(pd.DataFrame({"x": [[0.0, 1.0]], "y": [0], "w": [1.0]}), "softmax", False, None)
    L.save_checkpoint(str(tmp_path / "m"), trainer.network, spark, 1, 0.5, lr=5e-4)
    other = L.intent_head(2, 2, 4, seed=9)
    assert L.load_checkpoint(str(tmp_path / "m"), other, spark) == {"epoch": 2, "best": 0.5, "lr": 5e-4}
    assert other.t == trainer.network.t and all(np.allclose(a, b) for a, b in zip(other.state(), trainer.network.state()))
    assert L.unpack(df, "autoencoder").columns == ["x", "y"]
    with pytest.raises(ValueError):
        L.unpack(df, "other")


def test_translator():
    from verbena.operators import adapters

    loaded = []

    def load(path, device):
        loaded.append((path, device))
        return lambda texts: [t.upper() for t in texts]

    assert adapters.device(lambda: True) == "cuda:0" and adapters.device(lambda: False) == "cpu"
    chain = A.BackTranslation("fr", adapters.ModelTranslator(load, folder="/m"))
    with pytest.warns(UserWarning):
        assert chain.augment_texts(["good day", "word"]) == [">>FR<< GOOD DAY", ">>FR<< WORD"]
    assert [p for p, _ in loaded] == ["/m/opus-mt-en-fr", "/m/opus-mt-fr-en"] and chain.augment_texts([]) == []


def test_collate_and_validation(spark):
    def letters(texts, most):
        return [([ord(c) for c in t[:most]], [(i, i + 1) for i in range(len(t[:most]))]) for t in texts]

    row = L.collate(io.from_texts(spark, ["abc", None]), letters, max_length=2).orderBy("doc_id").collect()
    assert row[0]["input_ids"] == [97, 98] and row[0]["attention_mask"] == [1, 1] and row[0]["offsets"][1]["end"] == 2 and row[1]["input_ids"] == []
    df = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "id bigint, embedding array<double>, label int")
    trainer = L.Trainer(L.intent_head(2, 2, 8), "softmax", batch_size=8, lr=0.05, n_epochs=4, early_stopping=2)
    accuracy = lambda t: t.agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0]
    history = trainer.fit(df, "embedding", "label", validation=df.where("id < 10"), metrics={"accuracy": accuracy})
    assert max(h["accuracy"] for h in history) == 1.0


def test_augmented_training(spark):
    pairs = spark.createDataFrame([(i, f"word{i} cat", f"cat dog{i % 3}", 1.0) for i in range(40)], "guid bigint, s1 string, s2 string, label double")
    seen = {}

    def fit_cross(train, val, warmup):
        seen["cross"] = (train.count(), warmup)
        return lambda a, b: F.lit(0.5)

    def fit_bi(train, val, warmup):
        seen["bi"] = train.where("label = 0.5").count()
        return "model"

    model, test = retrieval.augmented_training(pairs, fit_cross, fit_bi, 2, 8)
    assert model == "model" and seen["cross"][1] == -(-(-(-seen["cross"][0] // 8)) // 10) and seen["bi"] > 0 and test.columns == pairs.columns


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text\n"a\nb"\nc\n')
    assert [r["text"] for r in io.read_csv(spark, str(tmp_path / "t.csv")).collect()] == ["a\nb", "c"]
    io.write_json(spark, {"a": 1}, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j")) == {"a": 1}
    registry = io.Registry()
    registry.add(Pipeline)
    assert registry.build({"class_name": "Pipeline", "config": {"punct": True}}).config.punct
    with pytest.raises(KeyError):
        registry.build({"class_name": "os.system"})
    log = io.append_log(str(tmp_path / "log"), "verbena.test")
    log.info("hello")
    assert "hello" in (tmp_path / "log").read_text()
    rows = spark.createDataFrame([(1, "PER", 4, 6), (1, "LOC", 0, 2)], "d int, l string, s int, e int")
    assert [tuple(s) for s in io.spans(rows, "l", "s", "e", "d").first()["spans"]] == [("LOC", 0, 2), ("PER", 4, 6)]


def test_stream_is_the_batch(spark, tmp_path):
    docs = io.from_texts(spark, ["One, two!", "", "three :)"])
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    pipe = Pipeline({"punct": True})
    stream = streams.clean_stream(streams.read_files(spark, str(tmp_path / "in"), "doc_id bigint, text string"), pipe)
    streams.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, pipe.fit_transform(docs).collect()))


def test_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 05:00:00", "b")], "t string, e string").select(F.to_timestamp("t").alias("t"), "e")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.event_counts(streams.read_files(spark, str(tmp_path / "in"), "t timestamp, e string"), "t", "e")
    streams.write(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["event"], r["n"]) for r in got] == [("a", 2)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
