"""Queries over vectors as small pictures: perceptual hashes, leaks and near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import grids
from loomwork.functions.vectors import doubles
from loomwork.operators import dedup
from loomwork.plans.tables import table
from loomwork.storage import stored

SIDE, DISTANCE = 8, 5
#: A picture saved anew keeps so many levels a unit of brightness.
LEVELS = 16


def _pictures(spark, sf_dir) -> DataFrame:
    """(vec_id, label, grid): the 64 components of every embedding as a grey picture of 8 x 8."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", doubles(F.col("embedding")).alias("grid"))


def _saved_anew(pictures: DataFrame) -> DataFrame:
    return pictures.withColumn("grid", F.transform("grid", lambda x: F.floor(x * LEVELS) / F.lit(float(LEVELS))))


def _hashes(grid: str = "grid"):
    g = F.col(grid)
    return {"phash": grids.cosine_hash(g, SIDE), "dhash": grids.gradient_hash(g, SIDE), "whash": grids.wavelet_hash(g, SIDE, 3)}


def cosine_hash(spark, sf_dir):
    return _pictures(spark, sf_dir).select("vec_id", _hashes()["phash"].alias("phash"))


def gradient_hash(spark, sf_dir):
    return _pictures(spark, sf_dir).select("vec_id", _hashes()["dhash"].alias("dhash"))


def wavelet_hash(spark, sf_dir):
    return _pictures(spark, sf_dir).select("vec_id", _hashes()["whash"].alias("whash"))


def picture_leaks(spark, sf_dir):
    """Training pictures (all, saved anew) within the distance of a test picture (those of the even classes) by the gradient hash."""
    hashed = _hashes()["dhash"].alias("hash")
    pictures = _pictures(spark, sf_dir)
    # stored, as the hashes are needed on both sides of the join and again for the rows
    train = stored(_saved_anew(pictures).select(F.concat(F.lit("train/"), F.col("vec_id").cast("string")).alias("path"), hashed))
    test = stored(pictures.where(F.col("label") % 2 == 0).select("vec_id", F.concat(F.lit("test/"), F.col("vec_id").cast("string")).alias("path"), hashed))
    return dedup.near_leaks(train, test, DISTANCE, "hash", "path", "vec_id", SIDE * (SIDE - 1)).select("path", "matched")


def picture_near_dup(spark, sf_dir):
    """All pictures and those saved anew (smaller files), each with the representative that it is a near duplicate of by any hash."""
    pictures = _pictures(spark, sf_dir)
    files = pictures.select((F.col("vec_id") * 2).alias("file_id"), F.lit(2).alias("size"), "grid")
    files = files.unionByName(_saved_anew(pictures).select((F.col("vec_id") * 2 + 1).alias("file_id"), F.lit(1).alias("size"), "grid"))
    hashed = stored(files.select("file_id", "size", *[h.alias(n) for n, h in _hashes().items()]))
    return dedup.greedy_clusters(hashed, "file_id", ["phash", "dhash", "whash"], [-F.col("size")], DISTANCE)


QUERIES = {f.__name__: f for f in (cosine_hash, gradient_hash, wavelet_hash, picture_leaks, picture_near_dup)}

_GRIDS = "p as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
_GRADIENT = grids.bits_sql(f"flatten(list_transform(range(0, {SIDE}), lambda r: list_transform(range(1, {SIDE}), lambda i: v[r * {SIDE} + i + 1] > v[r * {SIDE} + i])))")
_ABOVE = grids.bits_sql("list_transform(t, lambda x: x > list_median(t))")

ORACLES = {
    "cosine_hash": f"with {_GRIDS}, f as (select vec_id, {grids.transformed_sql('v', grids.cosine_matrix(SIDE))} as t from p) select vec_id, {_ABOVE} as phash from f",
    "gradient_hash": f"with {_GRIDS} select vec_id, {_GRADIENT} as dhash from p",
    "wavelet_hash": f"""with {_GRIDS}, f as (select vec_id, list_concat([0e0], ({grids.transformed_sql('v', grids.haar_matrix(SIDE, 3))})[2:]) as t from p) select vec_id, {_ABOVE} as whash from f""",
    "picture_leaks": f"""with {_GRIDS}, a as (select vec_id, {_GRADIENT} as h from (select vec_id, list_transform(v, lambda x: floor(x * {LEVELS}) / {LEVELS}) as v from p)),
b as (select vec_id, {_GRADIENT} as h from p where label % 2 = 0), fi as (select h, min(vec_id) as first, 'test/' || max(vec_id) as p from b group by h)
select 'train/' || vec_id as path, arg_min(p, first) as matched from a join fi on bit_count(xor(a.h, fi.h)) <= {DISTANCE} group by vec_id""",
}
