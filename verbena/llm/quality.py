"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a mask over those bits, so new policy versions and ablations never
read a text again.

Defined cases: a null text measures as the empty text, which fails ``empty`` only (the other
rules need a minimum of words); a null ``doc_id`` is kept as it is; repeated rows give repeated
ledger rows; an empty table gives an empty ledger and no ablation rows; extra input columns are
ignored by ``ledger`` and carried by ``apply_policy``, whatever their names. Measurements of a text of any
length are made of the whole text. Learned terms: a null text has none; labels of a null doc_id or
without a verdict are left out, and a doc_id with several labels is toxic if one says so.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import WORD

#: English words of abuse; a parameter of ``measurements``.
ABUSE = (
    "asshole", "bastard", "bitch", "clown", "creep", "cretin", "degenerate", "disgusting", "dumbass", "filth", "freak",
    "garbage", "idiot", "idiots", "imbecile", "loser", "losers", "moron", "morons", "pathetic", "pig", "retard", "scum",
    "scumbag", "shit", "slut", "stupid", "subhuman", "trash", "vermin", "whore", "worthless",
)
SYMBOLS = "#%&$*|<>{}^~"
MEASURES = ("n_chars", "n_words", "n_distinct", "n_letters", "n_upper", "n_symbols", "n_lines", "n_distinct_lines", "n_abuse")

#: name, SQL condition over the measurements (the same text serves Spark and the oracle).
RULES = (
    ("empty", "n_words = 0"),
    ("too_long", "n_words > 1000000"),
    ("long_words", "n_words >= 10 and n_letters > 15 * n_words"),
    ("short_words", "n_words >= 10 and n_letters < 2 * n_words"),
    ("few_letters", "n_words >= 10 and 100 * n_letters < 50 * n_chars"),
    ("upper_case", "n_words >= 10 and 100 * n_upper > 30 * n_letters"),
    ("symbols", "n_words >= 10 and 100 * n_symbols > 2 * n_chars"),
    ("repeated_words", "n_words >= 20 and 4 * n_distinct * n_distinct < 25 * n_words"),
    ("repeated_lines", "n_lines >= 5 and 100 * n_distinct_lines < 50 * n_lines"),
    ("abuse", "n_abuse > 0 and 2000 * n_abuse >= n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versioned policies: a document is rejected if it fails any rule of the mask.
POLICIES = {
    "v1": sum(BIT[r] for r in ("empty", "symbols", "repeated_words")),
    "v2": sum(BIT.values()) - BIT["abuse"] - BIT["long_words"],
    "v3": sum(BIT.values()),
}
PRODUCTION = "v3"
#: What no production run rejects for, though the ledger has its bit: a long text is no worse for its length.
NOT_REJECTED = BIT["too_long"]

#: Learned terms: a word, or a start of STARTS letters, in at least MIN_TOXIC toxic documents of the sample and at most one clean
#: document for 20 toxic ones. The sample has SAMPLE labelled rows at most, the terms are MAX_TERMS at most, the most frequent first.
STARTS = (4, 5, 6, 7, 8)
MIN_TOXIC = 4
SAMPLE = 20_000
MAX_TERMS = 2_000
#: The bit of the learned terms in ``learned_ledger``, after those of the rules.
LEARNED = 1 << len(RULES)


def measurements(text: Column, abuse: tuple[str, ...] = ABUSE) -> Column:
    """A struct of the measured quantities, all BIGINT; words and lines are split once, and each other one is one pass of a built-in function over the text."""
    left = lambda t, pattern: F.length(F.regexp_replace(t, pattern, ""))
    parts = lambda t, pattern: F.filter(F.split(t, pattern), lambda x: x != "")

    def measured(t: Column, words: Column, lines: Column) -> Column:
        out = {
            "n_chars": F.length(t),
            "n_words": F.size(words),
            "n_distinct": F.size(F.array_distinct(words)),
            "n_letters": left(t, r"[^\p{L}]+"),
            "n_upper": left(t, r"[^\p{Lu}]+"),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_lines": F.size(lines),
            "n_distinct_lines": F.size(F.array_distinct(lines)),
            "n_abuse": F.regexp_count(F.lower(t), F.lit(rf"\b(?:{'|'.join(abuse)})\b")),
        }
        return F.struct(*[out[k].cast("bigint").alias(k) for k in MEASURES])

    split = F.struct(F.coalesce(text, F.lit("")).alias("t"), parts(F.coalesce(text, F.lit("")), r"[ \t\r\n]+").alias("words"), parts(F.coalesce(text, F.lit("")), r"\n").alias("lines"))
    return let(split, lambda x: measured(x["t"], x["words"], x["lines"]))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, measurements, ``fail_bits`` and ``keep_<policy>`` for every policy version."""
    held = let(measurements(F.col(f"`{text_col}`")), lambda m: F.struct(*[m[k].alias(k) for k in MEASURES], _bits(m).alias("fail_bits")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held.alias("held")).select("doc_id", "held.*")
    return rows.select("*", *[(F.col("fail_bits").bitwiseAND(F.lit(m)) == 0).alias(f"keep_{v}") for v, m in POLICIES.items()])


_TERM = re.compile(r"\b[a-z_]+\b")


def _condition(sql: str, m: Column) -> Column:
    """The condition of a rule over a struct of measurements: sums, products and comparisons of them, joined by ``and``."""
    number = lambda x: reduce(lambda a, b: a * b, [m[f.strip()] if _TERM.fullmatch(f.strip()) else F.lit(int(f)) for f in x.split("*")])
    one = lambda c: next(op(*map(number, c.split(sign))) for sign, op in _COMPARE if sign in c)
    return reduce(lambda a, b: a & b, [one(c) for c in sql.split(" and ")])


_COMPARE = ((">=", operator.ge), ("<=", operator.le), ("=", operator.eq), ("<", operator.lt), (">", operator.gt))


def _bits(m: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for name, sql in RULES:
        total = total.bitwiseOR(F.when(_condition(sql, m), F.lit(BIT[name]).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return total


def ablation(ledger_df: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """For every policy and rule: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first reduced to counts per distinct ``fail_bits`` (at most 2**rules rows),
    so any number of policies costs one aggregation.
    """
    counts = ledger_df.groupBy("fail_bits").agg(F.count("*").alias("n"))
    grid = [(v, m, name, BIT[name]) for v, m in policies.items() for name, _ in RULES if m & BIT[name]]
    schema = "policy string, mask bigint, rule string, bit bigint"
    rules = ledger_df.sparkSession.createDataFrame(grid, schema)
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    return counts.crossJoin(F.broadcast(rules)).groupBy("policy", "rule").agg(
        n(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        n(hit == F.col("bit")).alias("n_only"),
        n(hit == 0).alias("n_kept"),
        n(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )


def fail_bits(text: Column, terms: list[tuple[int, str]] = ()) -> Column:
    """The bits of the rules that a text fails, and LEARNED if it has one of the learned terms."""
    bits = let(measurements(text), _bits)
    return bits.bitwiseOR(F.when(has_terms(text, terms), F.lit(LEARNED)).otherwise(F.lit(0)).cast("bigint")) if terms else bits


def apply_policy(docs: DataFrame, policy: str = PRODUCTION, text_col: str = "text", terms: list[tuple[int, str]] = ()) -> DataFrame:
    """The rows whose ledger bits pass a policy without those of NOT_REJECTED, with all their columns unchanged; learned terms reject as well.

    The bits are those of ``ledger`` and ``learned_ledger``: every rule is evaluated once a row, the policy is a mask over them.
    """
    mask = POLICIES[policy] & ~NOT_REJECTED | (LEARNED if terms else 0)
    return docs.where(fail_bits(F.col(f"`{text_col}`"), terms).bitwiseAND(F.lit(mask)) == 0)


def _words(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))


def _features(words: Column) -> dict[int, Column]:
    """The words at 0, and their starts of each length."""

    def starts(k: int) -> Column:
        return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.substring(w, 1, k)))

    return {0: words} | {k: starts(k) for k in STARTS}


def abuse_terms(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str]]:
    """Terms (length of the start or 0 for a word, term) of abuse in any language, from labels (doc_id, toxic)."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("i"), F.col("toxic").alias("y"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), F.col("id") == F.col("i"))

    def marked_by(k: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(k).alias("k"), x.alias("term")))

    terms = let(_words(F.col("t")), lambda w: F.concat(*[marked_by(k, found) for k, found in _features(w).items()]))
    counts = rows.select("y", F.explode(terms).alias("f")).groupBy("f.k", "f.term").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("bad"), F.count("*").alias("n"))
    found = counts.where((F.col("bad") >= MIN_TOXIC) & (20 * (F.col("n") - F.col("bad")) <= F.col("bad")))
    return [(r["k"], r["term"]) for r in found.orderBy(F.desc("bad"), "k", "term").limit(MAX_TERMS).collect()]


def has_terms(text: Column, terms: list[tuple[int, str]]) -> Column:
    """Whether a text has one of the learned terms: each distinct word is looked up once in the words, and its starts in those of their length."""
    own = {k: [t for n, t in terms if n == k] for k in (0, *STARTS)}

    def known(w: Column) -> Column:
        return reduce(lambda a, b: a | b, [(F.substring(w, 1, k) if k else w).isin(*found) for k, found in own.items() if found], F.lit(False))

    return F.exists(_words(text), known)


def learned_ledger(docs: DataFrame, terms: list[tuple[int, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``ledger`` with the bit LEARNED of ``fail_bits`` and ``keep_learned``: the newest policy and no learned term."""
    found = F.when(has_terms(F.col("text"), terms), F.lit(LEARNED)).otherwise(F.lit(0)).cast("bigint")
    held = let(measurements(F.col("text")), lambda m: F.struct(*[m[k].alias(k) for k in MEASURES], _bits(m).alias("fail_bits")))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = base.select("doc_id", held.alias("held"), found.alias("found")).select("doc_id", *[f"held.{k}" for k in MEASURES], F.col("held.fail_bits").bitwiseOR(F.col("found")).alias("fail_bits"))
    masks = POLICIES | {"learned": POLICIES[PRODUCTION] & ~NOT_REJECTED | LEARNED}
    return rows.select("*", *[(F.col("fail_bits").bitwiseAND(F.lit(m)) == 0).alias(f"keep_{v}") for v, m in masks.items()])


def ledger_sql() -> str:
    """DuckDB SQL of ``ledger`` over the table documents."""
    chars = lambda p: f"length(regexp_replace(t, '{p}', '', 'g'))"
    parts = lambda p: f"list_filter(string_split_regex(t, '{p}'), lambda x: x <> '')"
    cols = {
        "n_chars": "length(t)",
        "n_words": f"len(regexp_extract_all(t, '{WORD}'))",
        "n_distinct": f"len(list_distinct({parts('[ \\t\\r\\n]+')}))",
        "n_letters": chars(r"[^\p{L}]+"),
        "n_upper": chars(r"[^\p{Lu}]+"),
        "n_symbols": f"length(t) - length(translate(t, '{SYMBOLS}', ''))",
        "n_lines": f"len({parts('\\n')})",
        "n_distinct_lines": f"len(list_distinct({parts('\\n')}))",
        "n_abuse": rf"len(regexp_extract_all(lower(t), '\b(?:{'|'.join(ABUSE)})\b'))",
    }
    bits = " | ".join(f"(case when {sql} then {BIT[name]} else 0 end)" for name, sql in RULES)
    keeps = ", ".join(f"(fail_bits & {m}) = 0 as keep_{v}" for v, m in POLICIES.items())
    return (
        "with d as (select doc_id, coalesce(text, '') as t from documents), "
        f"m as (select doc_id, {', '.join(f'cast({v} as bigint) as {k}' for k, v in cols.items())} from d), "
        f"b as (select *, cast({bits} as bigint) as fail_bits from m) select *, {keeps} from b"
    )


def ablation_sql() -> str:
    """DuckDB SQL of ``ablation`` over the ledger of the table documents."""
    grid = ", ".join(f"('{v}', {m}, '{name}', {BIT[name]})" for v, m in POLICIES.items() for name, _ in RULES if m & BIT[name])
    n = lambda cond: f"count(*) filter (where {cond})"
    return (
        f"with l as ({ledger_sql()}), g(policy, mask, rule, bit) as (values {grid}) select policy, rule, "
        f"{n('(fail_bits & bit) <> 0')} as n_fail, {n('(fail_bits & mask) = bit')} as n_only, {n('(fail_bits & mask) = 0')} as n_kept, "
        f"{n('(fail_bits & mask & ~bit) = 0')} as n_kept_without from l cross join g group by policy, rule"
    )
