"""Every operator and every pipeline stage on empty tables, nulls, long texts, ties, repeats and clashing names."""

import pytest

import corpus_pipeline
from verbena.llm import licences, lines, mixing, neighbours, packing, passages, quality, simhash, tokens, wrappers

from .helpers import awkward, documents, rows

OPERATORS = {
    "quality": quality.ledger, "policy": quality.apply_policy, "licences": licences.scan, "simhash": simhash.groups, "dedup": simhash.dedup, "passages": passages.repeated_passages,
    "packing": packing.pack, "lines": lines.drop_common_lines, "tokens": tokens.token_counts, "schedule": mixing.schedule, "mix": mixing.mix,
}


ids = lambda rows_: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows_)
every = [(False, i) for i in (1, 2, 3, 4, 5, 5, 6, 6, 7, 8, 9, 10)] + [(True, 0)] * 2
texts = lambda rows_: {(r["doc_id"], r["text"]) for r in rows_}
#: What each operator makes of the awkward rows: nothing that isn't one of the stated cases is lost or added.
EXPECTED = {
    "quality": lambda r: ids(r) == every and {x["doc_id"] for x in r if x["n_words"] == 0} == {1, 2, 3, None},
    "policy": lambda r: set(ids(r)) == {*((False, i) for i in range(4, 11)), (True, 0)},
    "licences": lambda r: r == [],
    # the wordless texts of 1, 2 and 3 are copies, 8 is another one
    "simhash": lambda r: {(x["doc_id"], x["group_id"]) for x in r} == {(1, 1), (2, 1), (3, 1), *((i, i) for i in range(4, 11))},
    "dedup": lambda r: ids(r) == [(False, i) for i in (1, 4, 5, 6, 6, 7, 8, 9, 10)] + [(True, 0)] * 2,
    "passages": lambda r: {tuple(x) for x in r} == {(5, 0, 80)},
    "packing": lambda r: ids([x for x in r if x["piece"] == 0]) == every and sum(x["n_tokens"] for x in r if x["doc_id"] == 4) == 30_000,
    "lines": lambda r: ids(r) == every and texts(r) == {(i, t) for i, t, _ in awkward()},
    "tokens": lambda r: ids(r) == every and all((x["n_tokens"] == 0) == (x["doc_id"] in (1, 2)) for x in r if x["doc_id"] not in (3, None)),
    "schedule": lambda r: {(x["doc_id"], x["source"]) for x in r} == {(i, s) for i, _, s in awkward()},
    "mix": lambda r: texts(r) == {(i, t) for i, t, _ in awkward()},
}
STAGE_ROWS = {
    "quality_rules": EXPECTED["policy"], "line_dedup": EXPECTED["lines"], "near_dedup": EXPECTED["dedup"], "source_mixing": EXPECTED["mix"], "best_fit_packing": EXPECTED["packing"],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_and_empty(spark, name):
    run = OPERATORS[name]
    full = run(documents(spark, awkward()))
    assert EXPECTED[name](full.collect())
    empty = run(documents(spark, []))
    assert empty.count() == 0 and empty.columns == full.columns
    # the order and the partitioning of the rows don't matter
    again = run(documents(spark, awkward()[::-1]).repartition(3))
    assert rows(again) == rows(full)


@pytest.mark.parametrize("name", ["policy", "dedup", "lines", "mix"])
def test_columns_are_carried(spark, name):
    docs = documents(spark, awkward())
    out = OPERATORS[name](docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes


def test_counts_of_rows(spark):
    docs = documents(spark, awkward())
    assert quality.ledger(docs).count() == tokens.token_counts(docs).count() == len(awkward())
    assert lines.drop_common_lines(docs).count() == len(awkward())
    packed = packing.pack(docs)
    assert packed.where("piece = 0").count() == len(awkward())
    got = {(r["doc_id"], r["n_tokens"]) for r in tokens.token_counts(docs).collect()}
    assert (1, 0) in got and (2, 0) in got


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = documents(spark, awkward())
    out = run(spark, docs, "")
    assert STAGE_ROWS[name](out.collect())
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.dtypes == docs.dtypes
    assert run(spark, documents(spark, []), "").count() == 0


def test_vectors(spark):
    rows_ = [(1, [1.0, 0.0], "x"), (2, [0.0, 1.0], "x"), (3, [0.0, 1.0], "x"), (3, [5.0, 1.0], "x"), (4, None, "x"), (None, [1.0, 1.0], "x"), (5, [1.0, None], "x"), (6, [float("nan"), 1.0], "x"), (7, [1.0], "x"), (8, [0.0, 0.0], "x")]
    schema = "vec_id bigint, embedding array<float>, id string"
    got = [tuple(r) for r in neighbours.knn(spark.createDataFrame(rows_, schema), k=2).orderBy("vec_id", "rank").collect()]
    assert got == [
        (1, 1, 8, 1.0), (1, 2, 2, 1.414214), (2, 1, 3, 0.0), (2, 2, 8, 1.0), (3, 1, 2, 0.0), (3, 2, 8, 1.0), (8, 1, 1, 1.0), (8, 2, 2, 1.0),
    ]
    assert neighbours.knn(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.knn(spark.createDataFrame(rows_[:1], schema)).count() == 0


def test_pages(spark):
    schema = "page_id bigint, url string, html string, host string, key string"
    page = "<html><p>a</p><p>b &amp; c</p></html>"
    data = [(1, "http://h.org/1", page), (1, "http://h.org/1", page), (2, None, page), (None, "nonsense", "text only"), (3, "http://h.org/2", None), (4, "http://h.org/3", ""), (5, "http://h.org/4", "<p>unfinished <"), (6, "http://h.org/5", "<p>" * 20_000 + "x"), (7, "http://h.org/6", "<script>x")]
    df = spark.createDataFrame([(*r, "z", "z") for r in data], schema)
    out = wrappers.extract(df).collect()
    assert len(out) == len(data)
    assert [r["texts"] for r in out if r["page_id"] in (3, 4, 7)] == [[], [], []]
    assert [r["texts"] for r in out if r["page_id"] == 2] == [["a", "b & c"]]
    assert wrappers.extract(spark.createDataFrame([], schema)).count() == 0
    assert wrappers.wrappers(spark.createDataFrame([], schema)).count() == 0
