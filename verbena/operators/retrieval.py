"""BM25 retrieval, sentence pairs and their splits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import lower_words
from ..plans.materialise import cut
from .counts import term_statistics, word_pieces


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, query_id: str = "item_id", doc_id: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Rows (query_id, doc_id, score, rank): Okapi BM25 over an inverted index, ``k`` best documents a query, ties by id.

    A negative idf becomes ``epsilon`` times the mean idf. Document frequencies come from one pass over the words, summed by
    batch before they are shuffled. With up to ``WEIGHTS`` pairs of query and term, each batch of documents is scored against all
    queries where it lies and passes on its best ``k`` of each. With more, or where a doc_id has several rows, postings are made for
    the queries' terms only, and meet one row a term with all its queries: a broadcast where Catalyst finds that table small, and
    else a join whose frequent terms adaptive execution splits; scores are then summed per (query, document).
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), lower_words(F.col(text_col)).alias("w"))
    df, n, avg_len = term_statistics(d, F.col("w"))
    raw = df.select("term", (F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select(F.col(query_id).alias("query_id"), F.explode(lower_words(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = cut(q.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    if weights.count() <= WEIGHTS and d.groupBy("doc_id").count().where("count > 1").isEmpty():
        schema = StructType([StructField("query_id", weights.schema["query_id"].dataType), StructField("doc_id", d.schema["doc_id"].dataType), StructField("score", DoubleType())])
        scores = d.mapInArrow(_best(weights.orderBy("query_id", "term").toArrow(), k, k1, b, avg_len), schema).withColumn("score", F.round("score", 6))
    else:
        wanted = cut(weights.groupBy("term").agg(F.collect_list(F.struct("query_id", "weight")).alias("queries")))
        words_ = d.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(wanted.select("term"), "term", "left_semi")
        tf = words_.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
        share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len)))
        hits = tf.select("doc_id", "term", share.alias("share")).join(wanted, "term").select("doc_id", "share", F.explode("queries").alias("q"))
        scores = hits.groupBy(F.col("q.query_id").alias("query_id"), "doc_id").agg(F.round(F.sum(F.col("q.weight") * F.col("share")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


#: Pairs of query and term that are sent to the tasks, and scores that a worker has at a time.
WEIGHTS = 200_000
SCORES = 1 << 21


def _best(weights: pa.Table, k: int, k1: float, b: float, avg_len: float | None):
    """(doc_id, words) -> rows (query_id, doc_id, score): of each query the ``k`` best documents of a piece, and those that rounding may put before them."""
    term, queries = weights.column("term").combine_chunks().dictionary_encode(), weights.column("query_id").combine_chunks().dictionary_encode()
    by = np.argsort(term.indices.to_numpy(), kind="stable")
    known, names = term.dictionary, queries.dictionary
    query, weight = queries.indices.to_numpy()[by].astype(np.int64), weights.column("weight").to_numpy()[by]
    size = np.bincount(term.indices.to_numpy(), minlength=len(known))
    first = np.cumsum(size) - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(known):
                for rows, words, row in word_pieces(batch.column(1)):
                    code = pc.index_in(words, value_set=known)
                    length = np.bincount(row, minlength=rows.stop - rows.start)
                    held = code.is_valid().to_numpy(zero_copy_only=False)
                    pairs, tf = np.unique(row[held] * len(known) + code.drop_null().to_numpy(), return_counts=True)
                    doc, at = np.divmod(pairs, len(known))
                    share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avg_len))
                    step = max(1, SCORES // len(names))
                    for low in range(0, len(length), step):
                        own = slice(*np.searchsorted(doc, (low, low + step)))
                        yield from scored(batch.column(0).slice(rows.start + low, step), doc[own] - low, at[own], share[own])

    def scored(ids: pa.Array, doc: np.ndarray, at: np.ndarray, share: np.ndarray) -> Iterator[pa.RecordBatch]:
        score, hit = np.zeros((len(ids), len(names))), np.zeros((len(ids), len(names)), bool)
        ends = np.cumsum(size[at])
        start = 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SCORES, "right")))
            n = size[at[start:stop]]
            entry = np.repeat(first[at[start:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cell = np.repeat(doc[start:stop], n) * len(names) + query[entry]
            score += np.bincount(cell, np.repeat(share[start:stop], n) * weight[entry], score.size).reshape(score.shape)
            hit.ravel()[cell] = True
            start = stop
        score[~hit] = -np.inf
        if len(ids) > k:
            hit &= score >= np.partition(score, len(ids) - k, axis=0)[len(ids) - k] - 2e-6
        d, q = np.nonzero(hit)
        if len(d):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids.take(pa.array(d)), pa.array(score[d, q])], names=["query_id", "doc_id", "score"])

    return run


def sentence_pairs(table: DataFrame, first: str, second: str, label: str | None = None, guid: str | None = None) -> DataFrame:
    """Rows (guid, s1, s2, label)."""
    ident = F.col(guid) if guid else F.monotonically_increasing_id()
    return table.select(ident.alias("guid"), F.col(first).alias("s1"), F.col(second).alias("s2"), (F.col(label) if label else F.lit(None)).cast("double").alias("label"))


def split_80_10_10(table: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """The input with a column ``split``: train, val or test by a hash of the key, the same whatever the partitioning."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10))
    return table.withColumn("split", F.when(u < 8, "train").when(u < 9, "val").otherwise("test"))


def silver_pairs(gold: DataFrame, k: int = 10, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For each sentence of the pairs, its ``k`` best other sentences by BM25: rows (s1, s2, label); ``score`` is a cross-encoder adapter."""
    texts = gold.select(F.col("s1").alias("text")).union(gold.select("s2")).where("text is not null").distinct().withColumn("id", F.xxhash64("text"))
    hits = bm25(texts, texts, k + 1, "id", "id").where("query_id <> doc_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.withColumn("r", rank).where(F.col("r") <= k)
    pairs = hits.join(texts.select(F.col("id").alias("query_id"), F.col("text").alias("s1")), "query_id").join(texts.select(F.col("id").alias("doc_id"), F.col("text").alias("s2")), "doc_id")
    label = score(F.col("s1"), F.col("s2")) if score else F.lit(None)
    return pairs.select("s1", "s2", label.cast("double").alias("label"))


def augmented_training(
    pairs: DataFrame,
    fit_cross: Callable[[DataFrame, DataFrame, int], Callable[[Column, Column], Column]],
    fit_bi: Callable[[DataFrame, DataFrame, int], object],
    k: int = 10,
    batch_size: int = 16,
    epochs: int = 1,
    seed: int = 42,
):
    """Train a cross-encoder on gold pairs, let it label BM25 pairs, and train a bi-encoder on both; returns what ``fit_bi`` returns, and the test pairs.

    pairs: rows (guid, s1, s2, label). The models are adapters: ``fit_cross(train, val, warmup)`` returns a scoring
    expression, ``fit_bi(train, val, warmup)`` a model; the warm-up is a tenth of the training steps.
    """
    split = split_80_10_10(pairs, F.xxhash64("s1", "s2"), seed)
    gold, val, test = (split.where(F.col("split") == name).drop("split") for name in ("train", "val", "test"))
    warmup = lambda rows: -(-(-(-rows.count() // batch_size) * epochs) // 10)
    score = fit_cross(gold, val, warmup(gold))
    silver = silver_pairs(gold, k, score)
    both = gold.select("s1", "s2", "label").unionByName(silver)
    return fit_bi(both, val, warmup(both)), test
