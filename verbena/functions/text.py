"""Row-wise text cleaning as Column expressions; all of it stays in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons
from .vectors import let

#: What separates words: Unicode white space and the ASCII separators.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: A literal map is searched entry by entry; a longer lexicon goes through an Arrow UDF with a hash table.
MAP_LITERAL_MOST = 64


def words(text: Column) -> Column:
    """The words of a text as an array: split at any white space, no empty ones."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


def ngrams(tokens: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by a space; none where there are fewer than n words."""
    if n < 1:
        raise ValueError("n must be at least 1")

    def of(ws: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(ws) - n + 1)
        return F.when(F.size(ws) >= n, F.transform(at, lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)<.*?>", "")


def squeeze_repeats(text: Column) -> Column:
    """Runs of two or more equal characters become two."""
    return F.regexp_replace(text, r"(?d)(.)\1+", "$1$1")


def split_digits(text: Column) -> Column:
    """``3lines`` becomes ``3 lines``; ``iphone10`` stays."""
    return F.regexp_replace(text, r"(\p{Nd}+)([a-zA-Z]+)", "$1 $2")


def lookup(tokens: Column, mapping: dict[str, str]) -> Column:
    """Replace whole tokens that a lexicon has; the case counts."""
    if not mapping:
        return tokens
    if len(mapping) <= MAP_LITERAL_MOST:
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        return F.transform(tokens, lambda w: F.coalesce(F.try_element_at(table, w), w))

    @F.pandas_udf("array<string>")
    def replace(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [mapping.get(w, w) for w in ws])

    return replace(tokens)


@dataclass(frozen=True)
class Lexicons:
    contractions: dict | None = None
    slang: dict | None = None
    emoticons: dict | None = None

    def of(self, name: str) -> dict:
        given = getattr(self, name)
        return getattr(lexicons, name.upper()) if given is None else given


def clean(text: Column, config, tables: Lexicons = Lexicons()) -> Column:
    """Apply the cleaning actions that are on, in their fixed order; a text without any is returned as it is.

    ``config`` has the attributes eol_remove, eol_replace, html, repeated_chars, sep_digit_text, appos,
    slang, emoticons and emoticons_del. Whenever one is on, white space is collapsed as well.
    """
    on = [a for a in ("eol_remove", "eol_replace", "html", "repeated_chars", "sep_digit_text", "appos", "slang", "emoticons", "emoticons_del") if getattr(config, a)]
    if not on:
        return text
    out = text
    if config.eol_remove:
        out = F.regexp_replace(out, r"[\r\n]", "")
    elif config.eol_replace:
        out = F.regexp_replace(out, r"\r\n|\r|\n", ". ")
    if config.html:
        out = strip_html(out)
    if config.repeated_chars:
        out = squeeze_repeats(out)
    if config.sep_digit_text:
        out = split_digits(out)
    tokens = words(out)
    if config.appos:
        tokens = lookup(tokens, tables.of("contractions"))
    if config.slang:
        tokens = lookup(tokens, tables.of("slang"))
    if config.emoticons:
        tokens = lookup(tokens, tables.of("emoticons"))
    elif config.emoticons_del:
        tokens = lookup(tokens, {k: "" for k in tables.of("emoticons")})
    return F.array_join(tokens, " ")
