"""Deterministic sampling, quotas and dataset assembly.

Randomness is the rank of md5(seed:key), so a draw doesn't depend on partitioning, can be repeated anywhere and is uniform.
A rank over one huge pool is counted in two steps (hash prefix, then inside), so that no task orders the whole pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.storage import checkpointed


def draw(seed: str, *keys: str | Column) -> Column:
    """The random order of rows under a seed."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def ranked_by_draw(rows: DataFrame, by: list[str], seed: str, key: str, out: str = "rank", prefix: int = 3, drawn: Column | None = None) -> DataFrame:
    """`rows` with a random rank (from 1) inside each group, counted by hash prefix first, so a huge group is many tasks' work.

    `drawn` is the hash to order by where it isn't that of seed and key.
    """
    rows = rows.withColumn("_draw", draw(seed, key) if drawn is None else drawn).withColumn("_part", F.substring("_draw", 1, prefix))
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy("_draw", key)
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(parts, [*by, "_part"])
    return ranked.withColumn(out, F.col("_before") + F.col("_r")).drop("_draw", "_part", "_before", "_r")


def ranked_in_order(rows: DataFrame, by: str, order: list[Column], out: str = "rank") -> DataFrame:
    """`rows` with their rank (from 1) in an order inside each group: ranges of (group, order) are counted, then ranked inside, so no
    task orders a whole group. Where a row's range is has to be stored, as a range partition's ends are drawn anew each time. Rows without a group are one of their own."""
    keys = [f"_k{i}" for i in range(len(order))]
    ranges = rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(by, *keys)
    placed = checkpointed(ranges.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(by, "_part").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*keys)))
    ranked = ranked.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return ranked.withColumn(out, F.col("_before") + F.col("_r")).drop("_part", "_p", "_by", "_before", "_r", *keys)


def pick_per_group(rows: DataFrame, by: list[str], key: str, n: int | str, seed: str) -> DataFrame:
    """At most `n` rows (a number, or a column with each group's own) of each group, drawn without replacement.

    With a number, Spark keeps only the best of each group before it shuffles; with a column ranks are counted in two steps.
    """
    if isinstance(n, str):
        return ranked_by_draw(rows, by, seed, key, "_rank").where(F.col("_rank") <= F.col(n)).drop("_rank")
    order = Window.partitionBy(*by).orderBy(draw(seed, key), key)
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def distinct_paths(rows: DataFrame, path: str = "path", fold_case: bool = True) -> DataFrame:
    """One row for each path (by default whatever its case): the one whose path sorts first."""
    key = F.lower(path) if fold_case else F.col(path)
    return rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*rows.columns), path).alias("_row")).select("_row.*")


def even_quotas(classes: DataFrame, total: Column, order: Column, out: str = "quota", by: list[str] | None = None) -> DataFrame:
    """Split `total` over the classes (of each group `by`): the quotient each, and one more for the first of the order as far as the rest goes."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    ranked = classes.withColumns({"_k": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order))})
    quota = F.expr("_t div _k") + F.when(F.col("_i") <= F.col("_t") % F.col("_k"), 1).otherwise(0)
    return ranked.withColumn("_t", total.cast("long")).withColumn(out, quota.cast("long")).drop("_k", "_i", "_t")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(target, source) of every two different classes, a small table."""
    a, b = classes.select(F.col("cls").alias("target")), classes.select(F.col("cls").alias("source"))
    return a.join(F.broadcast(b), F.col("target") != F.col("source"))


def cross_quotas(sizes: DataFrame, divisor: int = 1) -> DataFrame:
    """(target, source, quota): each class needs as many negatives as it has items (over `divisor`), evenly from all other classes."""
    needs = sizes.select(F.col("cls").alias("target"), F.expr(f"n div {divisor}").alias("need"))
    return even_quotas(class_pairs(sizes).join(F.broadcast(needs), "target"), F.col("need"), F.col("source"), by=["target"])


def cross_negatives(items: DataFrame, quotas: DataFrame, key: str, seed: str = "cross") -> DataFrame:
    """(target, source, key): for each pair as many different items of the source as its quota says (all, if it has fewer)."""
    offered = items.select(F.col("cls").alias("source"), key).join(F.broadcast(quotas), "source")
    ranked = ranked_by_draw(offered, ["target", "source"], seed, key, "_r", drawn=draw(seed, "target", key))
    return ranked.where(F.col("_r") <= F.col("quota")).select("target", "source", key)


def top_up(items: DataFrame, quotas: DataFrame, sizes: DataFrame, key: str, seed: str = "topup") -> DataFrame:
    """(target, source, key, copy): what is missing where a source has fewer items than its quota, drawn with replacement."""
    short = quotas.join(F.broadcast(sizes.select(F.col("cls").alias("source"), "n")), "source").where(F.col("quota") > F.col("n"))
    asked = short.withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("quota") - F.col("n")).cast("int"))))
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("target").cast("string"), F.col("source").cast("string"), F.col("copy").cast("string"))), 1, 8), 16, 10).cast("long")
    asked = asked.withColumn("_at", F.pmod(spot, F.col("n")) + 1)
    placed = ranked_by_draw(items.select(F.col("cls").alias("source"), key), ["source"], seed, key, "_at")
    return asked.join(placed, ["source", "_at"]).select("target", "source", key, "copy")


def dealt(requests: DataFrame, pool: DataFrame, on: list[str], key: str, seed: str) -> DataFrame:
    """Deal each pool's items to its requests (`quota`, in order of `turn`), every item at most once; late requests come short.

    Cumulated quotas make ranges of ranks, and an item finds its request by its random rank: one join on the pool's key.
    """
    partition = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(1))
    upto = partition.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    spans = requests.withColumn("_to", F.sum("quota").over(upto)).withColumn("_from", F.col("_to") - F.col("quota"))
    key_of_pool = on or ["_one"]
    if not on:
        spans, pool = spans.withColumn("_one", F.lit(1)), pool.withColumn("_one", F.lit(1))
    ranked = ranked_by_draw(pool, key_of_pool, seed, key, "_rank")
    met = ranked.join(F.broadcast(spans), key_of_pool).where((F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to")))
    return met.drop("_from", "_to", "_rank", "_one")


def balanced_subset(pool: DataFrame, by: list[str], key: str, total: int, seed: str) -> DataFrame:
    """`total` rows of a pool, evenly from its groups (the whole pool if it isn't larger); short groups give all they have."""
    sizes = pool.groupBy(*by).agg(F.count("*").alias("_n"))
    if (sizes.agg(F.sum("_n")).first()[0] or 0) <= total:
        return pool
    quotas = even_quotas(sizes.select(*by), F.lit(total), draw(seed, *by), "_quota")
    return pick_per_group(pool.join(F.broadcast(quotas), by), by, key, "_quota", seed).drop("_quota")


def ratio_counts(total: int, ratios: tuple[float, ...] = (0.4, 0.4, 0.2)) -> list[int]:
    """Whole shares of a total: each rounded down, the last takes the rest."""
    shares = [int(total * r) for r in ratios[:-1]]
    return [*shares, total - sum(shares)]


def shuffled(rows: DataFrame, key: str, seed: str) -> DataFrame:
    """`rows` in a random order that can be repeated (a range partition and sort)."""
    return rows.orderBy(draw(seed, key), key)


def conversation(identity: Column, image: Column, question: Column, answer: Column, source: Column | None = None) -> Column:
    """A nested sample: id, image, two turns, and the true source where one is given."""

    def turn(who: str, value: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), value.alias("value"))

    fields = [identity.alias("id"), image.alias("image"), F.array(turn("human", question), turn("gpt", answer)).alias("conversations")]
    if source is not None:
        fields.append(F.struct(source.alias("true_source_category")).alias("metadata"))
    return F.struct(*fields)


def sequential_names(files: DataFrame, folder: str, name: str, ending: Column, order: Column, start: str | None = None) -> DataFrame:
    """`files` with `new_name`: folder + number + ending; numbers follow the order, from 1 or after the column `start`."""
    ranked = ranked_in_order(files, folder, [order, F.col(name)], "_i")
    number = F.col("_i") + (F.col(start) if start else F.lit(0))
    return ranked.withColumn("new_name", F.concat(F.col(folder), number.cast("string"), F.lit("."), ending)).drop("_i")
