"""TF-IDF in the two weightings the engine needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..functions.vectors import let
from ..plans.materialise import cut


def word_tokens(text: Column) -> Column:
    """Lower-cased words of at least two characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _weights(terms: DataFrame, key: str, idf) -> DataFrame:
    """(key, term) occurrences, or their counts k -> rows (key, term, tf, weight), of L2 norm 1 a key. ``idf`` takes the number of keys and the term's.

    Occurrences are counted once; the norm of a key is a sum that is joined back, so that a key of very many terms is no task of its own.
    """
    tf = cut(terms.groupBy(key, "term").agg((F.sum("k") if "k" in terms.columns else F.count("*")).alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct(key).alias("n"))  # one row
    # a row a term, as it is a sum over all keys; read twice
    scale = cut(df.crossJoin(F.broadcast(n)).select("term", idf(F.col("n"), F.col("df")).alias("idf")))
    raw = tf.join(scale, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(F.col(key).alias("__k")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("__norm"))
    return raw.join(norms, F.col(key).eqNullSafe(F.col("__k"))).select(key, "term", "tf", F.coalesce(F.try_divide(F.col("w"), F.col("__norm")), F.lit(0.0)).alias("weight"))


def topic_terms(
    labelled: DataFrame, label_col: str, text_col: str, stop_words: tuple[str, ...] = (), ngram_range: tuple[int, int] = (1, 1), min_df: float = 1, max_df: float = 1.0
) -> DataFrame:
    """Rows (label, term, tf, weight), a label's texts taken as one document; idf = ln((1 + n) / (1 + df)) + 1.

    Terms are the n-grams of ``ngram_range`` of the words that are no stop words; an n-gram doesn't cross texts. ``min_df`` and
    ``max_df`` are counts of labels, or shares of them if they are floats.
    """
    words = word_tokens(F.col(text_col))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    least, most = ngram_range
    terms = words if ngram_range == (1, 1) else let(words, lambda ws: F.concat(*[ngrams(ws, n) if n > 1 else ws for n in range(least, most + 1)]))
    rows = labelled.select(label_col, F.explode(terms).alias("term"))
    if (min_df, max_df) != (1, 1.0):
        rows = cut(rows.groupBy(label_col, "term").agg(F.count("*").alias("k")))
        n = rows.select(label_col).distinct().count()
        bound = lambda x: x * n if isinstance(x, float) else x
        df = rows.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= bound(min_df)) & (F.col("df") <= bound(max_df)))
        rows = rows.join(df, "term", "left_semi")
    return _weights(rows, label_col, lambda n, df: F.ln((1 + n) / (1 + df)) + 1)


def document_terms(docs: DataFrame, id_col: str, tokens: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """Rows (id, term, tf, weight) with idf = log2(n / df), over the terms of a vocabulary."""
    terms = docs.select(id_col, F.explode(tokens).alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary.select("term"), "term", "left_semi")
    return _weights(terms, id_col, lambda n, df: F.log2(n / df))


def dictionary(docs: DataFrame, tokens: Column, no_below: int = 15, no_above: float = 0.5, keep_n: int | None = 100_000) -> DataFrame:
    """Rows (term, df): in at least ``no_below`` documents and at most the share ``no_above``, the ``keep_n`` most frequent (None: all)."""
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = df.where((F.col("df") >= no_below) & (F.col("df") <= no_above * n))
    return found if keep_n is None else found.orderBy(F.desc("df"), "term").limit(keep_n)
