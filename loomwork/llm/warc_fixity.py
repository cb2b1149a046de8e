"""Fixity audit of WARC replicas by Merkle trees.

Records are laid out in order, each with its ordinal and its byte range. `merkle_levels` builds a tree over numbered leaves: a
node of each further level hashes the leaves or nodes of a fixed range of `fanout` numbers, and its byte range, which isn't
hashed, spans theirs.

The audit's leaves are a page each, and hash the digests and lengths of the page's records, not their places. They are numbered by the
original's manifest: a page has the ordinal of its first record there, in either replica. So numbers are dense whatever the page_ids
are, every level has a `fanout`-th of the nodes of the one below, and a record that is cut, lost or added anywhere changes its own
leaf and the nodes above it, and no others. Two replicas are compared from the top: only the children of nodes that differ are
looked at on the next level, down to the pages, whose records are then matched by content. What is left of a page is changed as far as
both replicas have records left, the rest is missing or added. Pages that the manifest hasn't have no number; they are added.
A record without page_id is a page of its own by its digest; a changed one is a missing one and an added one.

The order is found by a range partition whose place is stored; ordinals and offsets add up the partitions' sums, so no task sees
all rows. Nodes have `fanout` children at most. Defined cases: null urls or pages count as empty; records are ordered by page_id
(null first) and content, so repeated rows stand side by side; changed and missing records have the original's ordinal and place,
added ones the replica's; two empty replicas agree; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import stored

FANOUT = 64


def warc_records(pages: DataFrame) -> DataFrame:
    """(page_id, block): each page as a WARC response record, with its header and closing line ends."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", F.concat(header, html, F.lit("\r\n\r\n")).alias("block"))


def laid_out(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(page_id, ordinal, offset, octets, digest, leaf): the records in order of page_id and content, with their byte ranges and hashes."""
    spark = records.sparkSession
    facts = records.select("page_id", F.octet_length("block").cast("long").alias("octets"), F.sha2("block", 256).alias("digest"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(facts.repartitionByRange(n, "page_id", "digest").withColumn("part", F.spark_partition_id()))
    sums = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("octets").alias("o"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("o").over(before), F.lit(0)).alias("o0"))
    inside = Window.partitionBy("part").orderBy("page_id", "digest")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumns({"r": F.row_number().over(inside), "upto": F.sum("octets").over(upto)}).join(F.broadcast(sums), "part")
    offset = F.col("o0") + F.col("upto") - F.col("octets")
    return rows.select("page_id", (F.col("n0") + F.col("r") - 1).alias("ordinal"), offset.alias("offset"), "octets", "digest", F.sha2(F.concat_ws(":", offset.cast("string"), F.col("octets").cast("string"), F.col("digest")), 256).alias("leaf"))


_KEY = ["page_id", "own"]


def _keyed(laid: DataFrame) -> DataFrame:
    """`laid` with `own`: the digest of a record without page_id, which stands for its page."""
    return laid.withColumn("own", F.when(F.col("page_id").isNull(), F.col("digest")))


def _same_page(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in _KEY])


def page_leaves(laid: DataFrame) -> DataFrame:
    """(page_id, own, first, leaf, offset, octets): a leaf of each page, and the ordinal of its first record."""
    # equal records first become one with a count, so that copies don't meet in one leaf's list
    once = _keyed(laid).groupBy(*_KEY, "digest", "octets").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("octets")).alias("end"))
    records = F.array_sort(F.collect_list(F.concat_ws(":", "digest", F.col("octets").cast("string"), F.col("n").cast("string"))))
    leaves = once.groupBy(*_KEY).agg(F.min("first").alias("first"), F.sha2(F.array_join(records, ","), 256).alias("leaf"), F.min("begin").alias("offset"), F.max("end").alias("end"))
    return leaves.select(*_KEY, "first", "leaf", "offset", (F.col("end") - F.col("offset")).alias("octets"))


def merkle_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The tree's levels over leaves (ordinal, leaf, offset, octets), leaves first and the top last: (node, hash, begin, end)."""
    leaves = stored(leaves.select("ordinal", "leaf", "offset", "octets"))
    levels = [leaves.select(F.col("ordinal").alias("node"), F.col("leaf").alias("hash"), F.col("offset").alias("begin"), (F.col("offset") + F.col("octets")).alias("end"))]
    high = leaves.agg(F.max("ordinal")).first()[0] or 0
    while high > 0 or len(levels) == 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])
        up = levels[-1].groupBy(F.expr(f"node div {fanout}").alias("node")).agg(F.sha2(F.array_join(children, ""), 256).alias("hash"), F.min("begin").alias("begin"), F.max("end").alias("end"))
        levels.append(stored(up))
        high //= fanout
    return levels


def differing(one: list[DataFrame], other: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(ordinal) of the leaves that differ between two trees, or that only one of them has."""

    def compare(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("node").alias("node_b"), F.col("hash").alias("hash_b"))
        both = a.join(b, F.col("node") == F.col("node_b"), "full_outer").where(~F.col("hash").eqNullSafe(F.col("hash_b")))
        return both.select(F.coalesce("node", "node_b").alias("node"))

    height = max(len(one), len(other))
    one, other = ([*levels, *[None] * (height - len(levels))] for levels in (one, other))
    found = None
    for a, b in zip(one[::-1], other[::-1], strict=True):
        if a is None or b is None:  # one tree is higher: all of the next level has to be compared
            continue
        if found is not None:
            wrong = found.select(F.col("node").alias("parent"))
            a, b = (x.join(wrong, F.expr(f"node div {fanout}") == F.col("parent"), "left_semi") for x in (a, b))
        found = stored(compare(a, b))
    return found.select(F.col("node").alias("ordinal"))


def audit(records: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """page_id, ordinal, offset, octets and status of every record of either replica that differs."""
    a, b = stored(laid_out(records)), stored(laid_out(replica))
    ours, theirs = stored(page_leaves(a)), page_leaves(b)
    manifest = ours.select(F.col("page_id").alias("m_page_id"), F.col("own").alias("m_own"), F.col("first").alias("number"))
    numbered = stored(theirs.join(manifest, _same_page("", "m_"), "left").drop("m_page_id", "m_own"))
    known = numbered.where("number is not null").select(F.col("number").alias("ordinal"), "leaf", "offset", "octets")
    found = differing(merkle_levels(ours.withColumnRenamed("first", "ordinal"), fanout), merkle_levels(known, fanout), fanout)
    pages = ours.join(found, F.col("first") == found["ordinal"], "left_semi").select(*_KEY)
    pages = stored(pages.unionByName(numbered.where("number is null").select(*_KEY)).toDF("w_page_id", "w_own"))

    def inside(laid: DataFrame) -> DataFrame:
        """The records of pages that differ; `r` counts equal ones."""
        rows = _keyed(laid).join(pages, _same_page("", "w_"), "left_semi").select("page_id", "ordinal", "offset", "octets", "digest")
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("ordinal")))

    left, right = stored(inside(a)), stored(inside(b))

    def unmatched(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("r").alias("s"))
        rows = x.join(y, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("r") == F.col("s")), "left_anti")
        place = F.when(F.col("page_id").isNotNull(), F.row_number().over(Window.partitionBy("page_id", F.when(F.col("page_id").isNull(), F.col("digest"))).orderBy("ordinal")))
        return rows.withColumn("place", place).drop("r", "digest")

    gone, come = unmatched(left, right), unmatched(right, left)
    pairs = come.select(F.col("page_id").alias("p"), F.col("place").alias("q"), F.lit(True).alias("paired"))
    changed = gone.join(pairs, (F.col("page_id") == F.col("p")) & (F.col("place") == F.col("q")), "left").withColumn("status", F.when(F.col("paired"), "changed").otherwise("missing"))
    known = gone.select(F.col("page_id").alias("p"), F.col("place").alias("q"))
    added = come.join(known, (F.col("page_id") == F.col("p")) & (F.col("place") == F.col("q")), "left_anti").withColumn("status", F.lit("added"))
    return changed.drop("p", "q", "paired", "place").unionByName(added.drop("place"))


def with_planted_faults(records: DataFrame, changed: tuple[int, int] = (97, 13), cut: tuple[int, int] = (101, 5), lost: tuple[int, int] = (89, 7), added: tuple[int, int] = (83, 3)) -> DataFrame:
    """A replica with faults all over, each where page_id leaves the second number when divided by the first: closing line ends
    swapped (which keeps all lengths), records cut after 40 characters, records lost, and further records added beside a page's own."""

    def hit(rule: tuple[int, int]) -> Column:
        return F.coalesce(F.col("page_id") % rule[0] == rule[1], F.lit(False))

    block, n = F.col("block"), F.length("block")
    swapped = F.concat(block.substr(F.lit(1), n - 4), F.lit("\n\r\n\r"))
    kept = records.where(~hit(lost)).withColumn("block", F.when(hit(changed), swapped).when(hit(cut), block.substr(1, 40)).otherwise(block))
    extra = records.where(hit(added)).withColumn("block", F.concat(F.lit("WARC/1.1 extra record of page "), F.col("page_id").cast("string")))
    return kept.unionByName(extra)


#: The same in DuckDB: both replicas are built, laid out and compared record by record.
ORACLE_SQL = r"""
with r as (select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
  || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as block from pages),
s as (select page_id, case when page_id % 97 = 13 then left(block, length(block) - 4) || chr(10) || chr(13) || chr(10) || chr(13) when page_id % 101 = 5 then left(block, 40) else block end as block
  from r where coalesce(page_id % 89 <> 7, true) union all select page_id, 'WARC/1.1 extra record of page ' || page_id::varchar from r where page_id % 83 = 3),
a as (select page_id, strlen(block) as octets, sha256(block) as digest, row_number() over w - 1 as ordinal, sum(strlen(block)) over w - strlen(block) as "offset" from r
  window w as (order by page_id nulls first, sha256(block) rows between unbounded preceding and current row)),
b as (select page_id, strlen(block) as octets, sha256(block) as digest, row_number() over w - 1 as ordinal, sum(strlen(block)) over w - strlen(block) as "offset" from s
  window w as (order by page_id nulls first, sha256(block) rows between unbounded preceding and current row)),
an as (select *, row_number() over (partition by page_id, digest order by ordinal) as copy from a),
bn as (select *, row_number() over (partition by page_id, digest order by ordinal) as copy from b),
gone as (select *, row_number() over (partition by page_id order by ordinal) as place from an anti join bn using (page_id, digest, copy)),
come as (select *, row_number() over (partition by page_id order by ordinal) as place from bn anti join an using (page_id, digest, copy))
select gone.page_id, gone.ordinal::bigint as ordinal, gone."offset"::bigint as "offset", gone.octets::bigint as octets, case when come.place is null then 'missing' else 'changed' end as status
  from gone left join come on gone.page_id = come.page_id and gone.place = come.place
union all select page_id, ordinal::bigint, "offset"::bigint, octets::bigint, 'added' from come anti join gone using (page_id, place)
"""
