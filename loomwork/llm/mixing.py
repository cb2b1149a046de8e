"""Mixing sources to target weights by thresholds on a hash.

Every row has a draw: 120 bits of md5 over its id and content, then a number that no other row has. Rows of a source are taken from the
smallest draw up, until the source's budget is met, and the largest budget's rows hold those of all smaller ones. No row is sorted:
sizes are summed by source and by the first 12 bits of the draw, a running sum over these at most 4,096 cells finds the cell in
which the budget ends, and only the rows of that cell are summed again by the next 12 bits, until it is one row. That row
is taken if this brings the source nearer to its target. What is stored and read again are ids, sources, sizes and draws, not texts.

A target is the source's share of the budget by weight, but not more than `most` times its size: the water level of this rule is
found from sums alone, so neither rows nor sources pass through the driver. A target of more than the source's size takes every
row as often as it fits, and once more the rows below the threshold, so no row is taken more than `most` times.

Defined cases: a null text or one without words has size 0; rows without a source are a source of their own, the last one; a null
doc_id stays null; of repeated rows, as many are taken as fit (which ones can't be told); an empty table gives no rows; other columns are ignored.
Reruns take the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import stored

PART_BITS, CELL_BITS = 60, 12
_PARTS = ("_d0", "_d1", "_d2")
_BY = ("source", "budget")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, draw), stored: the draw is three numbers of 60 bits."""
    own = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    number = lambda at: F.conv(F.substring("_own", at, PART_BITS // 4), 16, 10).cast("long")
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), own.alias("_own"))
    return stored(rows.select("doc_id", "source", "size", number(1).alias("_d0"), number(1 + PART_BITS // 4).alias("_d1"), F.monotonically_increasing_id().alias("_d2")))


def source_sizes(sizes: DataFrame) -> DataFrame:
    """(source, source_size), stored."""
    return stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """`sources` with a weight: the given ones in turn, by the source's code points, the null source last.

    The place of a source is its place in its range and the sizes of the ranges before, so no task has all sources.
    """
    ordered = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    counts = ordered.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    turn = F.pmod(F.col("_before") + F.col("_i") - 1, F.lit(len(weights))).cast("int")
    placed = ordered.withColumn("_i", within).join(earlier, "_range")
    return placed.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"))


def targets(weighted: DataFrame, budget: float, most: float = 3.0) -> DataFrame:
    """`weighted` (source, source_size, weight) with its target: the budget by weight, at most `most` times the source's size, the excess
    shared by weight among the others until none is above. The level rises with each round; only two sums and a count come back from one.
    """
    level, full, own = 0.0, -1, most * F.col("source_size")
    while True:
        above = level * F.col("weight") > own
        facts = weighted.agg(F.count_if(above), F.sum(F.when(above, F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        if facts[0] == full or not facts[2]:
            break
        full, level = facts[0], (budget - most * (facts[1] or 0)) / facts[2]
    # with nothing left to share, every source is full
    return weighted.withColumn("target", F.least(own, level * F.col("weight")) if facts[2] else own)


def _prefixes(level: int) -> list[Column]:
    """What the first 12 * (level + 1) bits of a draw are, as one number for each part that they reach into."""
    each = PART_BITS // CELL_BITS
    whole, bits = divmod(level + 1, each)
    columns = [F.col(p) for p in _PARTS[:whole]]
    return columns + ([F.shiftright(_PARTS[whole], PART_BITS - CELL_BITS * bits)] if bits else [])


def _same(names: list[str], others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(names, others, strict=True)])


def boundaries(sizes: DataFrame, wanted: DataFrame) -> tuple[DataFrame, int]:
    """For each row of `wanted` (source, budget, rest) where its rest ends: (source, budget, rest, below, at0.., size), and the
    level at which each such cell has one row. Sources whose rows are all below have none.
    """
    asked = wanted.select(F.col("source").alias("_source"), "budget", "rest", F.lit(0).cast("long").alias("below"))
    names: list[str] = []
    for level in range(len(_PARTS) * PART_BITS // CELL_BITS):
        now = [f"at{i}" for i in range(len(_prefixes(level)))]
        rows = sizes.select("source", "size", *[c.alias(n) for c, n in zip(_prefixes(level), now, strict=True)], *[c.alias(f"_{n}") for c, n in zip(_prefixes(level - 1) if level else [], names, strict=True)])
        old = asked.select("_source", "budget", "rest", "below", *[F.col(n).alias(f"_old_{n}") for n in names])
        met = rows.join(old, _same(["source", *[f"_{n}" for n in names]], ["_source", *[f"_old_{n}" for n in names]]))
        cells = met.groupBy(*_BY, *now).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        upto = Window.partitionBy(*_BY).orderBy(*now).rowsBetween(Window.unboundedPreceding, 0)
        summed = cells.withColumn("_upto", F.col("below") + F.sum("size").over(upto)).where(F.col("_upto") > F.col("rest"))
        first = summed.groupBy(*_BY).agg(F.min(F.struct("_upto", *now, "size", "n", "rest")).alias("c"))
        found = first.select(*_BY, "c.rest", (F.col("c._upto") - F.col("c.size")).alias("below"), *[f"c.{n}" for n in now], "c.size", "c.n")
        found, names = stored(found), now
        asked = found.withColumnRenamed("source", "_source")
        if not found.where("n > 1").limit(1).count():
            break
    return found, level


def mix(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """For each row of `sizes` and each budget of its source, what is taken of it.

    `aims` (source, source_size, budget, target): several budgets of a source give nested choices. Returns (doc_id, source, size,
    source_size, budget, target, taken).
    """
    # thresholds are looked up in stored tables, which Spark broadcasts only if their files are small
    aims = stored(aims.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")))
    ends, level = boundaries(sizes, aims)
    names = [c for c in ends.columns if c.startswith("at")]
    ends = ends.select(F.col("source").alias("_s"), F.col("budget").alias("_b"), F.struct(*names).alias("_end"), (F.col("below") + F.col("size") - F.col("rest") < F.col("rest") - F.col("below")).alias("_last"))
    plans = stored(aims.join(ends, _same(list(_BY), ["_s", "_b"]), "left").withColumnRenamed("source", "_source").drop("_s", "_b"))
    rows = sizes.withColumn("_own", F.struct(*[c.alias(n) for c, n in zip(_prefixes(level), names, strict=True)]))
    met = rows.join(plans, _same(["source"], ["_source"]))
    once_more = F.col("_end").isNull() & (F.col("rest") > 0) | (F.col("_own") < F.col("_end")) | (F.col("_own") == F.col("_end")) & F.col("_last")
    taken = F.col("size") * (F.col("times") + F.coalesce(once_more, F.lit(False)).cast("long"))
    return met.select("doc_id", "source", "size", "source_size", "budget", "target", taken.cast("long").alias("taken"))


def mix_to_weights(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budgets: tuple[float, ...] = (1.0,), most: float = 3.0) -> DataFrame:
    """All documents, once for each budget (a share of all words), with what a mix of their sources by weight takes of them."""
    sizes = sized(docs)
    weighted = stored(cycled_weights(source_sizes(sizes), weights))
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    aims = [targets(weighted, b * total, most).withColumn("budget", F.lit(float(b))) for b in budgets]
    return mix(sizes, reduce(DataFrame.unionByName, aims).drop("weight"))


def mixture(docs: DataFrame) -> DataFrame:
    """What a mix of as many words as there are takes of every document, with weights of 5, 2 and 1 in turn."""
    return mix_to_weights(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB, with a running sum over each source's rows in order of their draws.
ORACLE_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as draw from documents),
s as (select source, sum(size)::bigint as s, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as w from d group by source),
o as (select *, row_number() over (order by 3 * s / w, source nulls last) as i from s),
c as (select i, coalesce(sum(s) over (order by i rows between unbounded preceding and 1 preceding), 0)::double as full_size, sum(w) over (order by i rows between current row and unbounded following) as w_left, 3 * s / w as bound from o),
l as (select (select sum(s)::double from o) as total),
level as (select (total - 3 * full_size) / w_left as level from c, l where (total - 3 * full_size) / w_left <= bound order by i limit 1),
t as (select source, s, least(3.0::double * s, w * coalesce((select level from level), 0)) as target from s),
a as (select *, case when s > 0 then floor(target / s)::bigint else 0 end as times, target - (case when s > 0 then floor(target / s) else 0 end) * s as rest from t),
q as (select d.*, a.s, a.target, a.times, a.rest, sum(d.size) over (partition by d.source order by substr(draw, 1, 30), r rows unbounded preceding) as upto from d join a on d.source is not distinct from a.source)
select doc_id, size, s as source_size, target, (size * (times + case when upto <= rest then 1 when upto - size <= rest and upto - rest < rest - (upto - size) then 1 else 0 end))::bigint as taken from q
"""
