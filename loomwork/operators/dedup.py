"""De-duplication: equal contents across sets, perceptual hashes within a Hamming distance, greedy near-duplicate clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.near_pairs import LISTED, near_decided, near_pairs, slice_masks
from loomwork.operators.sampling import ranked_in_order
from loomwork.storage import checkpointed, stored

#: Items of the greedy walk's first stretch (each next one is three times what is before it), and pairs that one task walks over at most.
FIRST_STRETCH, WALKED = 4096, 1 << 20


def content_duplicates(candidates: DataFrame, reference: DataFrame, content: str, path: str, order: str) -> DataFrame:
    """The candidates whose content stands in the reference, with `matched`: the last reference path of that content. Null contents match nothing.

    Contents are reduced to one row each before the join, so a content with very many copies is no hot key on either side.
    """
    last = reference.where(F.col(content).isNotNull()).groupBy(F.col(content).alias("_c")).agg(F.max_by(path, order).alias("matched"))
    return candidates.join(last, F.col(content) == F.col("_c")).drop("_c")


def content_keepers(candidates: DataFrame, reference: DataFrame, content: str) -> DataFrame:
    """The candidates whose content isn't in the reference, and those without content."""
    return candidates.join(reference.where(F.col(content).isNotNull()).select(F.col(content).alias("_c")).distinct(), F.col(content) == F.col("_c"), "left_anti")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_hash(vec: Column, bits: int = 64) -> Column:
    """A hash with bit i set where component i isn't negative."""
    def bit(i: Column) -> Column:
        return F.when(F.get(vec, i) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))


def band_masks(distance: int, bits: int = 64) -> list[int]:
    """The bits, as signed numbers, of every choice of three (fewer for few bits) of distance + 3 slices.

    Hashes within the distance have at least three clean slices, so they agree in at least one choice. With 64 bits and a
    distance of 5 there are 56 choices of 24 bits; the 6 single slices that would do as well have 10 or 11 bits, which a large
    table fills.
    """
    return slice_masks(distance, 3, bits)


def bands(value: Column, distance: int, bits: int = 64) -> Column:
    """What a hash holds in each of the masks: array<struct<band, part>>."""
    choices = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(band_masks(distance, bits))])
    return F.transform(choices, lambda c: F.struct(c["band"].alias("band"), value.bitwiseAND(c["mask"]).alias("part")))


def first_band(a: Column, b: Column, distance: int, bits: int = 64) -> Column:
    """The first band in which two hashes agree (null: none)."""
    found = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(band_masks(distance, bits)))):
        found = F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)).otherwise(found)
    return found


def hamming_pairs(left: DataFrame, right: DataFrame, distance: int, hash_column: str = "hash", bits: int = 64) -> DataFrame:
    """(left_hash, right_hash) of all distinct hashes within the distance: joined by equal bands, then verified.

    Only distinct hashes meet; rows come back by an equi-join on them, so equal hashes are never paired with each other here. A pair
    that meets in several bands is taken from the first of them, so the pairs aren't shuffled to find equal ones. Spark takes a table of bands
    to be as small as its hashes, so a merge join is asked for: otherwise one with dozens of rows a hash could be broadcast.
    """
    a = left.where(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("left_hash")).distinct()
    b = right.where(F.col(hash_column).isNotNull()).select(F.col(hash_column).alias("right_hash")).distinct()
    if distance == 0:
        return a.join(b, F.col("left_hash") == F.col("right_hash"))
    a = a.select("left_hash", F.inline(bands(F.col("left_hash"), distance, bits)))
    b = b.select("right_hash", F.inline(bands(F.col("right_hash"), distance, bits))).hint("merge")
    met = a.join(b, ["band", "part"]).where(hamming(F.col("left_hash"), F.col("right_hash")) <= distance)
    return met.where(F.col("band") == first_band(F.col("left_hash"), F.col("right_hash"), distance, bits)).select("left_hash", "right_hash")


def near_leaks(train: DataFrame, test: DataFrame, distance: int, hash_column: str, path: str, order: str, bits: int = 64) -> DataFrame:
    """The training rows within the distance of a test row, with `matched`: the first test hash wins, its last path is reported."""
    firsts = test.where(F.col(hash_column).isNotNull()).groupBy(F.col(hash_column).alias("right_hash")).agg(F.min(order).alias("_first"), F.max_by(path, order).alias("_path"))
    pairs = hamming_pairs(train, test, distance, hash_column, bits)
    match = pairs.join(firsts, "right_hash").groupBy("left_hash").agg(F.min_by("_path", "_first").alias("matched"))
    return train.join(match, F.col(hash_column) == F.col("left_hash")).drop("left_hash")


def greedy_clusters(items: DataFrame, key: str, hashes: list[str], order: list[Column], distance: int = 5, stretch: int = FIRST_STRETCH, listed: int = LISTED, walked: int = WALKED) -> DataFrame:
    """(key, duplicate_of): walk the items in order; one near an earlier representative (by any hash) is its duplicate, else a representative.

    Items with equal hashes are one node, and nodes are numbered in order. Growing stretches of them are decided one after the other:
    only representatives of the stretches before and nodes that are near none of them meet, so hashes near very many others don't meet
    them all. An item that lacks a hash is a duplicate of nothing.
    """
    whole = reduce(lambda x, y: x & y, [F.col(h).isNotNull() for h in hashes])
    without = items.where(~whole).select(key, F.lit(None).cast(items.schema[key].dataType).alias("duplicate_of"))
    ranked = items.where(whole).select(key, *hashes, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(key).alias("k")).alias("_o"))
    nodes = ranked.groupBy(*hashes).agg(F.min("_o").alias("_o")).withColumn("_all", F.lit(0))
    nodes = stored(ranked_in_order(nodes, "_all", [F.col("_o")], "_item").select("_item", F.col("_o")["k"].alias("_node"), *hashes))
    firsts = items.sparkSession.createDataFrame([], "late long, early long")
    total, start, end = nodes.count(), 1, 1 + stretch
    while start <= total:
        left = nodes.where(F.col("_item") < end).join(firsts, F.col("_item") == F.col("late"), "left_anti").select(F.col("_item").alias("item"), *hashes)
        if start > 1:
            near = near_decided(left, hashes, start, distance)
            gone = checkpointed(near.groupBy("late").agg(F.min("early").alias("early")))
            firsts = firsts.unionByName(gone)
            left = left.where(F.col("item") >= start).join(gone, F.col("item") == F.col("late"), "left_anti")
        near = checkpointed(near_pairs(left, hashes, distance, listed))
        found, certain = _decided(near, walked)
        firsts = firsts.unionByName(found)
        while not certain:
            # only who is near another one has to meet the others again, without the duplicates that are known by now
            some = near.select(F.explode(F.array("late", "early")).alias("item")).distinct().join(found, F.col("item") == F.col("late"), "left_anti")
            left = checkpointed(left.join(some, "item", "left_semi"))
            near = checkpointed(near_pairs(left, hashes, distance, listed))
            found, certain = _decided(near, walked)
            firsts = firsts.unionByName(found)
        start, end = end, 4 * end
    named = nodes.join(firsts, F.col("_item") == F.col("late"), "left").drop("_item", "late")
    named = named.join(nodes.select(F.col("_item").alias("early"), F.col("_node").alias("_first")), "early", "left").drop("early")
    same = ranked.drop("_o").join(named, hashes)
    own = F.when(F.col("_first").isNotNull(), F.col("_first")).when(F.col(key) != F.col("_node"), F.col("_node"))
    return same.select(key, own.alias("duplicate_of")).unionByName(without)


def _decided(near: DataFrame, walked: int) -> tuple[DataFrame, bool]:
    """(late, early) of the duplicates and their first representatives, as far as they are certain, and whether all are.

    Neighbours after a list's cut aren't known, so an item is doubtful if its first representative is after the cut of one of its lists. Up
    to the first doubtful item all is as if the lists were whole; items that aren't doubtful and have a representative before it are
    certain. The cut list of the first doubtful item holds only certain duplicates, so there are always some.
    """
    pairs = near.where("early < late").select("late", "early")
    duplicates = _duplicates(pairs, walked).select(F.col("late").alias("early"))
    found = pairs.join(duplicates, "early", "left_anti").groupBy("late").agg(F.min("early").alias("early"))
    cuts = near.where("cut").groupBy("late").agg(F.min("early").alias("last"))
    found = checkpointed(found.join(cuts, "late", "full"))
    first = found.where("last < coalesce(early, late)").agg(F.min("late")).first()[0]
    certain = found.where("early is not null and (last is null or early <= last)")
    if first is not None:
        certain = certain.where(F.col("early") < first)
    return certain.select("late", "early"), first is None


def _duplicates(pairs: DataFrame, walked: int) -> DataFrame:
    """(late) of pairs of undecided items: who has an earlier neighbour that isn't a duplicate itself.

    Neighbours of items without an earlier one are found in rounds over all tasks, until `walked` pairs or less are left for one task.
    """
    found = []
    while pairs.count() > walked:
        roots = pairs.select("early").distinct().join(pairs.select(F.col("late").alias("early")), "early", "left_anti")
        found.append(checkpointed(pairs.join(roots, "early", "left_semi").select("late").distinct()))
        pairs = pairs.join(found[-1], "late", "left_anti").join(found[-1].select(F.col("late").alias("early")), "early", "left_anti")
        pairs = checkpointed(pairs.select("late", "early"))
    last = pairs.coalesce(1).sortWithinPartitions("late", "early").mapInArrow(_walked, "late long")
    return checkpointed(reduce(DataFrame.unionByName, found, last))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The duplicates of pairs in order of (late, early)."""
    found = set()
    for batch in batches:
        for late, early in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if early not in found:
                found.add(late)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], ["late"])


def delete_manifest(duplicates: DataFrame, path: str, reason: str, duplicate_of: Column) -> DataFrame:
    """What would be deleted and why; nothing is touched."""
    return duplicates.select(F.col(path).alias("path"), F.lit(reason).alias("reason"), duplicate_of.alias("duplicate_of"))


def colliding(manifest: DataFrame, new_path: str) -> DataFrame:
    """`manifest` with `collides`: another row has the same new path."""
    return manifest.withColumn("collides", F.count("*").over(Window.partitionBy(new_path)) > 1)
