"""Mixing sources to target weights with a low-discrepancy schedule.

Slot n takes the golden-ratio point frac(n * phi), kept as an exact 32-bit integer, and maps it
through the cumulative weights to a source. Slots are ranked per source; a source's documents,
shuffled by hash, are laid end to end and cut into blocks of equal tokens (a document belongs
to the block in which it starts); rank r of a source takes its block r modulo its blocks. The
schedule ends at the first slot by which every block has been taken once, so no document is lost
and sources below their weight come again (epoch 1, 2, ...). By default weights are the square
roots of the sources' tokens.

A source whose weight is tiny beside its blocks would make the others come again without end before
its last block is drawn. So a share is raised, where it is lower, to what lets the source come whole
within about ``REPEAT`` times the blocks of all sources: the length of a schedule follows the tokens,
whatever the weights, and every source with a weight above 0 has an interval.

Defined cases: rows with the same (doc_id, source) are one document whose tokens add up and are
scheduled together, each row kept; a null source is a source, a null doc_id a document of it; a
null or empty text has no tokens and lies in the block where it falls; a source without any
tokens counts as one token; a source absent from explicit weights (or at weight 0) is left out;
a block in which no document starts leaves its slot empty, its tokens being those of the long
document before it; an empty table gives an empty schedule; further columns are carried
unchanged, whatever their names, apart from those named like the schedule's in ``schedule``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import cut
from .common import fresh, running_total, word_count

BLOCK_TOKENS = 16_384
SEED = 17
#: 2**32 / golden ratio, odd; points are n * PHI modulo 2**32.
PHI = 2_654_435_769
ONE = 1 << 32
REPEAT = 4
#: Points are joined with the intervals of sources by their cell, a run of 2**CELL points.
CELL = 20


def _slots_of(blocks: str) -> str:
    """Points within which a share p has surely met ``blocks`` of them, times p.

    The golden rotation comes back to an interval of length p within 1.9 / p points, and the number of
    hits among n points differs from n * p by far less than 64.
    """
    return f"least(3 * {blocks}, {blocks} + 64)"


def _units(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("t"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.groupBy("doc_id", "source").agg(F.sum("t").alias("n_tokens")).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))


def intervals(per: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (source, blocks, need, lo, hi) of rows (source, tokens, w), one a source: its blocks, and its interval of the 2**32 points.

    The sums run over the table of sources, in decimals as the products pass 2**63.
    """
    per = per.withColumn("blocks", F.expr(f"(tokens + {block_tokens} - 1) div {block_tokens}")).withColumn("need", F.expr(_slots_of("blocks")))
    per = per.selectExpr("*", f"greatest(w, (cast(need as decimal(20,0)) * sum(w) over ()) div ({REPEAT} * sum(blocks) over ()) + 1) as raised")
    per = per.selectExpr("*", f"greatest(1L, (cast(raised as decimal(20,0)) * ({ONE} - count(*) over ())) div (sum(raised) over ())) as width")
    return per.selectExpr("source", "blocks", "need", "(sum(width) over (order by source nulls first)) - width as lo", "sum(width) over (order by source nulls first) as hi")


def point(slot: Column) -> Column:
    """slot * PHI modulo 2**32, by the halves of the slot so that no product passes 2**63."""
    high, low = F.shiftright(slot, 16).bitwiseAND(65535), slot.bitwiseAND(65535)
    return ((high * PHI).bitwiseAND(65535) * 65536 + low * PHI).bitwiseAND(ONE - 1)


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Rows (slot, epoch, source, block, doc_id, n_tokens, start): one for every time a document is drawn."""
    spark = docs.sparkSession
    units = cut(_units(docs, id_col, source_col, text_col, seed))
    placed = running_total(units, ["source"], "bucket", ["key", "doc_id"], {"start": "n_tokens"})
    placed = placed.withColumn("block", F.expr(f"start div {block_tokens}"))

    per = units.groupBy("source").agg(F.greatest(F.sum("n_tokens"), F.lit(1)).cast("bigint").alias("tokens"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("tokens").cast("double")) * 1024)
    else:
        held = {k: max(1, round(v * 1e6)) for k, v in weights.items() if v > 0}
        table = F.create_map(*[x for k, v in held.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]) if held else F.lit(None).cast("map<string,bigint>")
        weight = F.coalesce(F.try_element_at(table, "source"), F.lit(0)).cast("bigint")
    marks = cut(intervals(per.withColumn("w", weight).where("w > 0"), block_tokens))
    bound = marks.selectExpr(f"max((cast(need as decimal(20,0)) * {ONE}) div (hi - lo) + 1) as n").first()["n"] or 0
    cells = marks.select("source", "blocks", "lo", "hi", F.explode(F.expr(f"sequence(shiftright(lo, {CELL}), shiftright(hi - 1, {CELL}))")).alias("cell"))
    slots = spark.range(1, bound + 1).select(F.col("id").alias("slot"), point(F.col("id")).alias("p"), F.expr("id div 65536").alias("part"), F.lit(1).alias("one"))
    slots = slots.withColumn("at", F.shiftright("p", CELL))
    drawn = cut(slots.join(cells, (F.col("at") == F.col("cell")) & (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).select("slot", "part", "source", "blocks", "one"))
    ranked = running_total(drawn, ["source"], "part", ["slot"], {"rank": "one"})
    last = ranked.where(F.col("rank") == F.col("blocks") - 1).agg(F.max("slot").alias("last"))
    ranked = (
        ranked.join(F.broadcast(last), F.col("slot") <= F.col("last"))
        .select("slot", F.expr("rank div blocks").alias("epoch"), F.col("source").alias("s"), (F.col("rank") % F.col("blocks")).alias("b"))
    )
    # a source's end without tokens starts at its last block's end and stays in that block
    ends = marks.select(F.col("source").alias("es"), (F.col("blocks") - 1).alias("top"))
    placed = placed.join(ends, F.col("source").eqNullSafe(F.col("es"))).withColumn("block", F.least("block", "top"))
    return placed.join(ranked, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("slot", "epoch", "source", "block", "doc_id", "n_tokens", "start")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The input's rows as often as the schedule draws them, with the input's columns."""
    i, s = fresh(docs, "i", "s")
    plan = schedule(docs, id_col=id_col, source_col=source_col, **options).select(F.col("doc_id").alias(i), F.col("source").alias(s))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(s))
    return docs.join(plan, same).select(*[F.col(f"`{c}`") for c in docs.columns])


def schedule_sql(block_tokens: int = BLOCK_TOKENS, seed: int = SEED, source: str = "documents") -> str:
    """DuckDB SQL of ``schedule`` with the default weights."""
    b = block_tokens
    return f"""
with u as (select doc_id, source, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0))::bigint as n_tokens from {source} group by all),
k as (select *, md5(concat_ws('|', '{seed}', coalesce(source, ''), coalesce(doc_id::varchar, ''))) as key from u),
c as (select *, (coalesce(sum(n_tokens) over (partition by source order by key, doc_id rows between unbounded preceding and 1 preceding), 0))::bigint as start from k),
p as (select source, greatest(sum(n_tokens), 1)::bigint as tokens, floor(sqrt(greatest(sum(n_tokens), 1)::double) * 1024)::bigint as w from u group by source),
q as (select *, (tokens + {b} - 1) // {b} as blocks, {_slots_of(f"((tokens + {b} - 1) // {b})")} as need from p),
x as (select *, greatest(w, (need::hugeint * sum(w) over ()) // ({REPEAT} * sum(blocks) over ()) + 1) as raised from q),
y as (select *, greatest(1, (raised::hugeint * ({ONE} - count(*) over ())) // (sum(raised) over ())::hugeint)::bigint as width from x),
m as (select source, blocks, need, (sum(width) over (order by source nulls first) - width)::bigint as lo, (sum(width) over (order by source nulls first))::bigint as hi from y),
n as (select max((need::hugeint * {ONE}) // (hi - lo) + 1)::bigint as n from m),
s as (select r as slot, (r * {PHI}) & {ONE - 1} as p from (select unnest(range(1, (select n + 1 from n))) as r)),
d as (select slot, source, blocks, row_number() over (partition by source order by slot) - 1 as rank from s join m on p >= lo and p < hi),
l as (select max(slot) as last from d where rank = blocks - 1),
t as (select slot, rank // blocks as epoch, source, rank % blocks as block from d, l where slot <= last),
e as (select c.*, least(c.start // {b}, m.blocks - 1) as block from c join m on c.source is not distinct from m.source)
select t.slot, t.epoch, e.source, e.block, e.doc_id, e.n_tokens, e.start from e join t on e.source is not distinct from t.source and e.block = t.block"""
