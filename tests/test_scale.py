"""Whole results and bounded memory where tables are larger than the test tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verbena.plans import registry


def test_tfidf_keeps_every_term_of_its_sql(spark, tmp_path):
    # 100,100 terms in 15 of 30 documents: the SQL has no greatest number of terms
    words = " ".join(f"w{i}" for i in range(100_100))
    spark.range(30).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15, words).otherwise("other").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES["tfidf_documents"](spark, str(tmp_path)).select("term").distinct().count() == 100_101


def test_keyword_words_are_held_in_pieces(spark, monkeypatch):
    from verbena.operators import features

    made = []

    class Counted(features.Words):
        def __init__(self, texts):
            made.append(sum(len(t or "") for t in texts))
            super().__init__(texts)

    import pyarrow as pa

    texts = [f"a b{i % 7} c {'x ' * (i % 50)}" for i in range(40_000)] + [None, "", "y " * features.PIECE]
    monkeypatch.setattr(features, "Words", Counted)
    found = next(features.bucket_counts(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert max(made[:-1]) <= features.PIECE < sum(made) and made[-1] == 2 * features.PIECE
    held = pd.DataFrame({c: found.column(c).to_pylist() for c in ("n", "held")}).groupby("n")["held"].sum()
    sizes = [len((t or "").split()) for t in texts]
    assert [held[n] for n in (1, 2, 3, 4)] == [sum(max(0, s - n + 1) for s in sizes) for n in (1, 2, 3, 4)]
    counts = pd.concat(features.vocabulary_counts(["a", "x x"]).func(iter([pd.Series(texts)])))
    assert np.array_equal(np.stack(counts), [[t.split().count("a"), max(0, t.split().count("x") - 1)] if t else [0, 0] for t in texts])


def test_fitted_pipeline_annotates_what_is_read(spark):
    from verbena.operators.pipeline import Pipeline, RuleAnnotator
    from verbena.sources.io import from_texts

    asked = []

    class Recorded(RuleAnnotator):
        def annotate(self, text, fields=None):
            asked.append(fields)
            return super().annotate(text, fields)

    docs = from_texts(spark, ["Anna's dogs cannot run .", "a  b, c"])
    config = {"punct": True, "single_char": True, "proper_noun": True, "extra_space": True}
    model = Pipeline(config, Recorded()).fit(docs)
    got = [r["words"] for r in model.tokenize().orderBy("doc_id").collect()]
    assert asked[-1] == {"text", "is_punct", "single_char", "proper_noun", "is_space"}
    kept = Pipeline(config)
    kept.docs = Pipeline(config).annotate(docs)
    assert got == [r["words"] for r in kept.tokenize().orderBy("doc_id").collect()] and "dogs" in got[0]
    assert [r["text"] for r in model.set(proper_noun=False).transform().orderBy("doc_id").collect()][0].startswith("Anna")


def test_short_ways_of_tokens(spark):
    import random

    from verbena.functions.vectors import let
    from verbena.operators import pipeline
    from verbena.sources.io import from_texts

    parts = ["cannot", "can", "not", "n't", "'s", "'VE", "www.", "http://a.b/c", "a@b.co", ".", ",", " ", "  ", "\n", "é", "É", "ß", "İ", "x", "Paul", "paul", "S", "ss", "ies", "ly", "ing", "12", "3.5", "_", "-", "…", "́", "seventeen", "Million"]
    draw = random.Random(5)
    docs = from_texts(spark, ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(2000)])
    slow = pipeline._TOKEN[pipeline._TOKEN.index("|[") + 1 :]
    for options in ({}, {"given_names": ("paul", ".", "Paul"), "stop_words": (".", "x"), "lemmas": ((".", "dot"), ("x", "why"), ("é", "e"))}, {"keep": ("lemmas",)}):
        rules = pipeline.RuleAnnotator(**options)
        whole = lambda raw: F.transform(raw, lambda t, i: F.struct(*[c.alias(k) for k, c in rules._any(t, i, raw).items()]))  # noqa: B023, E731
        both = docs.select(rules.annotate(F.col("text")).alias("a"), let(F.regexp_extract_all("text", F.lit(slow), F.lit(0)), whole).alias("b"))
        assert both.where("not (a <=> b)").limit(3).collect() == []


def test_pos_features_keep_a_tally(spark, tiny):
    from verbena.operators.features import BagOfPOS
    from verbena.operators.pipeline import Pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id bigint, text string"))
    annotated = Pipeline().annotate(docs)
    model = BagOfPOS("tag").fit(annotated)
    tallied = annotated.select("doc_id", model.tally(F.col("tokens")).alias("tags"))
    assert BagOfPOS("tag").fit(tallied).feature_names == model.feature_names
    both = model.transform(tallied).select("doc_id", F.col("features").alias("f")).join(model.transform(annotated), "doc_id")
    assert both.where("not (f <=> features)").count() == 0 and both.count() == 202


def test_grid_multiplies_strips(spark):
    from verbena.operators import vectors as G

    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    shapes = G.grid(v, lambda ids, x, ids2, x2, _: {"i": np.array([len(ids)]), "j": np.array([len(ids2)])}, "i bigint, j bigint", 2000).toPandas()
    assert shapes["i"].max() <= G.STRIP < shapes["j"].max() and (shapes["i"] * shapes["j"]).sum() == 3000 * 3000
    # a task passes on k rows of a vector at most, and the nearest of all blocks stay
    got = G.top_k(v, 3, 200).toPandas().sort_values(["i", "sim"], ascending=[True, False])
    sim = x @ x.T
    np.fill_diagonal(sim, -np.inf)
    assert (got["j"].to_numpy().reshape(3000, 3) == np.argsort(-sim, axis=1)[:, :3]).all()
    near = G.within(v, 0.3, block_rows=700).count()
    assert near == (np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.3).sum() - 3000


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_optics_gets_lists_and_no_vectors(spark, metric):
    from verbena.operators import clustering as C

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])] + [rng.normal(0, 1, (40, 3))])
    ids = rng.permutation(len(x)) * 7
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x)], "id bigint, v array<double>")
    eps = 0.3 if metric == "euclidean" else 0.05
    found = C.optics(v, eps, 4, metric)
    got = [r["label"] for r in found.orderBy("id").collect()]
    assert got == C.optics_labels(x[np.argsort(ids)], eps, 4, metric).tolist() and max(got) >= 1
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert C.optics(v.limit(0), eps, 4, metric).count() == 0


def test_bm25_is_scored_where_the_documents_lie(spark, monkeypatch):
    from verbena.operators import counts, retrieval

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, rng.integers(0, 30)) % 60) for _ in range(300)] + [None, "", "w1 w2"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    queries = spark.createDataFrame([("a", "w1 w2 w2"), ("b", "w5 w59 none"), ("c", ""), ("d", "w3")], "item_id string, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = retrieval.bm25(queries, docs, 5)
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each posting
    got = rows(found)
    monkeypatch.setattr(retrieval, "WEIGHTS", 0)
    by_join = rows(retrieval.bm25(queries, docs, 5))
    assert got == by_join and len(got) == 15
    doubled = docs.union(docs.where("doc_id < 5"))  # rows of one doc_id are one document, by the join
    by_join = rows(retrieval.bm25(queries, doubled, 5))
    monkeypatch.setattr(retrieval, "WEIGHTS", 1000)
    assert rows(retrieval.bm25(queries, doubled, 5)) == by_join
    assert retrieval.bm25(queries.limit(0), docs, 5).count() == 0 and retrieval.bm25(queries, docs.limit(0), 5).count() == 0

    words = F.split(F.col("text"), " ")
    table, n, mean = counts.term_statistics(docs, words)
    lists = [t.split(" ") for t in texts if t is not None]
    assert n == len(texts) and np.isclose(mean, np.mean([len(w) for w in lists]))
    assert {r["term"]: (r["df"], r["n"]) for r in table.collect()} == {w: (sum(w in x for x in lists), sum(x.count(w) for x in lists)) for w in {w for x in lists for w in x}}
