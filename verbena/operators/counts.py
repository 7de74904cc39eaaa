"""Word and n-gram counts. Counting combines on the map side, so a frequent word is no hot key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lower_words, ngrams


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (word, n): lower-cased words between white space."""
    return count_ngrams(docs, 1, text_col).withColumnRenamed("ngram", "word")


def count_ngrams(docs: DataFrame, n: int = 2, text_col: str = "text") -> DataFrame:
    """Rows (ngram, n); n-grams don't cross documents."""
    tokens = lower_words(F.col(text_col))
    return docs.select(F.explode(tokens if n == 1 else ngrams(tokens, n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def count_tokens(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Rows (word, n) of annotated documents, by the tokens' lower-cased text."""
    return docs.select(F.explode(tokens_col).alias("t")).groupBy(F.lower("t.text").alias("word")).agg(F.count("*").alias("n"))


#: Words that a worker looks at together: an Arrow batch is limited in rows only.
PIECE = 1 << 20


def word_pieces(lists: pa.Array) -> Iterator[tuple[slice, pa.Array, np.ndarray]]:
    """(rows, words, row of each word from 0) of an array of word lists, in pieces of at most ``PIECE`` words, or of one row."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
        yield slice(start, stop), lists.slice(start, stop - start).flatten(), np.repeat(np.arange(stop - start), sizes[start:stop])
        start = stop


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = held = total = 0
    names = ["term", "df", "n"]
    for b in batches:
        rows, held = rows + b.num_rows, held + b.num_rows - b.column(0).null_count
        for _, words, row in word_pieces(b.column(0)):
            total += len(words)
            if len(words):
                coded = words.dictionary_encode()
                code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                pairs = np.sort(row * size + code)
                df = np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % size, minlength=size)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(df), pa.array(np.bincount(code, minlength=size))], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.string()), pa.array([rows, held]), pa.array([-1, total])], names=names)


def term_statistics(docs: DataFrame, tokens: Column) -> tuple[DataFrame, int, float | None]:
    """Rows (term, df, n) of the words of documents, the number of documents, and their mean length in words; one pass, materialised.

    Words are counted by their codes in each Arrow batch, so a row for each different word of a piece is shuffled and not one for each of a document.
    """
    from ..plans.materialise import cut

    parts = docs.select(tokens.alias("w")).mapInArrow(_term_rows, "term string, df bigint, n bigint")
    # rows without a term: documents at n = -1, and those that have words, with all words as n
    kind = F.when(F.col("term").isNull(), F.when(F.col("n") < 0, 1).otherwise(2)).otherwise(0)
    counts = cut(parts.groupBy("term", kind.alias("kind")).agg(F.sum("df").alias("df"), F.sum("n").alias("n")))
    sums = {r["kind"]: r for r in counts.where("kind > 0").collect()}  # two rows
    held = sums[2]["df"] if 2 in sums else 0
    return counts.where("kind = 0").select("term", "df", "n"), sums[1]["df"] if 1 in sums else 0, sums[2]["n"] / held if held else None
