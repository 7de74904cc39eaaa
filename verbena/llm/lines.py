r"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

A line's places in its document travel with its hash, so that a document is put together again from the
stretches between the places it loses. A line is normalised by lower case and by single spaces; blank lines are never counted or
dropped. Every line that occurs in at least ``min_docs`` documents is dropped from all of them.
Only hashes are shuffled for the count; texts move once, to meet the hashes that their document
loses. With ``by_content``, documents of one normalised text count as one, and with ``groups``
(doc_id, group_id), documents of one group do, so a text that is copied keeps its own lines, and near
dedup decides which copy stays. With ``near_copies`` the groups are those of near copies, found only as far as the count needs them.

Defined cases: a null text stays null; an empty text stays empty; a document that loses every
line stays as a row with an empty text; rows that share a doc_id are one document for the count,
and each of them is rewritten; by content, a text counts under its least doc_id, and texts that
differ in case, white space or blank lines only are one; a doc_id without a group is one of its own; null doc_ids count together as one document; a line that repeats
in one document counts once; an empty table gives an empty table; further columns, whatever
their names, are carried unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import let
from .common import fresh, keep
from .groupcount import lines_in_groups

MIN_DOCS = 10


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r]+", " "))


def _hash(line: Column) -> Column:
    """Two independent hashes of a normalised line, 96 bits together."""
    n = normalised(line)
    return F.struct(F.xxhash64(n).alias("h"), F.hash(n).alias("g"))


def _content(text: Column) -> Column:
    """Two independent hashes of all normalised lines of a text."""
    t = F.trim(F.regexp_replace(normalised(text), r" ?\n[ \n]*", "\n"))
    t = F.regexp_replace(t, r"^\n|\n$", "")
    return F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("g"))


def drop_common_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", by_content: bool = False, groups: DataFrame | None = None, near_copies: bool = False) -> DataFrame:
    """The input with ``text_col`` rewritten without its common lines; same columns, same rows."""
    ident, version, lost = fresh(docs, "id", "v", "lost")
    content = [_content(F.col("text")).alias("c")] if by_content else []
    same = ["c"] if by_content else []
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = base.select("id", F.xxhash64("text").alias("v"), *content, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(~F.col("line").rlike(r"^[ \t\r]*$"))
    # one row a document and line, with the places of the line in its texts
    keyed = lines.select("id", "v", *same, "at", _hash(F.col("line")).alias("k"))
    hashed = keep(keyed.groupBy("id", *same, "k.h", "k.g").agg(F.collect_list(F.struct("v", "at")).alias("places")))  # read twice
    counted = hashed
    if groups is not None:
        of = groups.where("doc_id <> group_id").select(F.col("doc_id").alias("i"), F.col("group_id").alias("r"))
        counted = hashed.join(of, F.col("id") == F.col("i"), "left").select(F.coalesce("r", "id").alias("id"), *same, "h", "g").distinct()
    if by_content:
        counted = counted.groupBy("h", "g", "c").agg(F.min("id").alias("id")).select("id", "h", "g").distinct()
    if near_copies:
        common = lines_in_groups(counted.select("h", "g", "id"), docs, min_docs, id_col, text_col)
    else:
        common = counted.groupBy("h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h", "g")
    per_doc = (
        hashed.join(common, ["h", "g"], "left_semi")
        .select("id", F.explode("places").alias("p"))
        .groupBy(F.col("id").alias(ident), F.col("p.v").alias(version))
        .agg(F.array_sort(F.collect_set("p.at")).alias(lost))
    )
    text = F.col(f"`{text_col}`")
    joined = docs.join(per_doc, F.col(f"`{id_col}`").eqNullSafe(F.col(ident)) & (F.xxhash64(text) == F.col(version)), "left")
    kept = let(F.struct(F.split(text, "\n").alias("lines"), F.col(lost).alias("lost")), _without)
    new = F.when(F.col(lost).isNotNull(), kept).otherwise(text)
    return joined.select(*[(new if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def _without(x: Column) -> Column:
    """The lines but those at the sorted places ``lost`` (from 0): the stretches between them, in time linear in the lines."""
    edges = F.concat(F.array(F.lit(-1)), x["lost"], F.array(F.size(x["lines"])))

    def stretches(e: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda j: F.slice(x["lines"], F.get(e, j) + 2, F.get(e, j + 1) - F.get(e, j) - 1))

    return F.array_join(F.flatten(let(edges, stretches)), "\n")


def drop_common_lines_sql(min_docs: int = MIN_DOCS, source: str = "documents") -> str:
    """DuckDB SQL of the rewritten (doc_id, text) rows of a table whose doc_ids are distinct."""
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[ \\t\\r]+', ' ', 'g'))"
    return (
        f"with l as (select doc_id, pos, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {source})), "
        f"n as (select *, {norm('line')} as k from l), "
        f"c as (select k from n where k <> '' group by k having count(distinct doc_id) >= {min_docs}), "
        "r as (select doc_id, string_agg(line, chr(10) order by pos) as t from n where k = '' or k not in (select k from c) group by doc_id) "
        f"select d.doc_id, case when d.text is null then null else coalesce(r.t, '') end as text from {source} d left join r using (doc_id)"
    )
