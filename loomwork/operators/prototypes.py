"""Class prototypes from reference items: sampling, centroids, caches, outlier trimming, clustering."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.vectors import dot, mean_vectors, midpoint, unit
from loomwork.operators.bounded import bounded
from loomwork.operators.quantiles import exact_percentiles
from loomwork.operators.sampling import pick_per_group
from loomwork.storage import stored


def few_shot(items: DataFrame, label: str, key: str, shots: int, seed: str = "shots", complete: bool = False) -> DataFrame:
    """`shots` items of each class, by hash rank. complete: a class with fewer is an error."""
    chosen = pick_per_group(items, [label], key, shots, seed)
    if complete:
        short = [r[label] for r in bounded(chosen.groupBy(label).count()).where(F.col("count") < shots).collect()]
        if short:
            raise ValueError(f"classes with fewer than {shots} items: {sorted(short)}")
    return chosen


def others(items: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The evaluation items: those that weren't chosen."""
    return items.join(chosen.select(*keys), keys, "left_anti")


def centroids(items: DataFrame, label: str, vec: str = "vec") -> DataFrame:
    """(cls, vec): unit vectors' mean by class, made a unit vector again."""
    means = mean_vectors(items.select(F.col(label).alias("cls"), unit(F.col(vec)).alias("_v")), ["cls"], "_v", "_m")
    return means.select("cls", unit(F.col("_m")).alias("vec"))


def cache_keys(views: DataFrame, key: str, label: str, vec: str = "vec", epoch: str = "epoch") -> DataFrame:
    """(key_id, vec, label): the mean over augmentation epochs of vectors as they are, then normalised; labels of the first epoch."""
    means = mean_vectors(views.select(F.col(key).alias("key_id"), vec), ["key_id"], vec, "_m")
    labels = views.groupBy(F.col(key).alias("key_id")).agg(F.min_by(label, epoch).alias("label"))
    return means.join(labels, "key_id").select("key_id", unit(F.col("_m")).alias("vec"), "label")


def pair_mean(pairs: DataFrame, label: str, image: str, text: str) -> DataFrame:
    """(cls, vec): the mean of the midpoints of image and text vectors; not normalised."""
    return mean_vectors(pairs.select(F.col(label).alias("cls"), midpoint(F.col(image), F.col(text)).alias("_v")), ["cls"], "_v", "vec")


def trimmed(items: DataFrame, label: str, vec: str = "vec", share: float = 0.95) -> DataFrame:
    """`items` with `distance` (1 - cosine to the class's mean), `edge` (its exact percentile) and `kept`; no task orders a class."""
    means = bounded(mean_vectors(items.select(F.col(label).alias("_c"), vec), ["_c"], vec, "_mean"))
    far = items.join(means, F.col(label) == F.col("_c")).withColumn("distance", F.lit(1.0) - dot(F.col(vec), F.col("_mean"))).drop("_mean", "_c")
    # distances are stored for the passes that look for the percentile
    edges = bounded(exact_percentiles(stored(far.select(F.col(label).alias("_c"), "distance")), "_c", "distance", share))
    return far.join(edges, F.col(label) == F.col("_c")).drop("_c").withColumn("kept", F.col("distance") <= F.col("edge") + 1e-12)


def trimmed_mean(items: DataFrame, label: str, vec: str = "vec", share: float = 0.95) -> DataFrame:
    return mean_vectors(trimmed(items, label, vec, share).where("kept").select(F.col(label).alias("cls"), vec), ["cls"], vec, "vec")


def clustered_prototype(items: DataFrame, key: str, shots: int, vec: str = "vec", k: int = 2, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """The `shots` items nearest to the centre of the larger cluster (of two like ones: to the centres' mean), and that centre."""
    points = items.withColumn("features", array_to_vector(vec))
    model = KMeans(k=k, seed=seed, maxIter=50, tol=1e-9).fit(points)
    sizes = model.summary.clusterSizes
    centres = [c.tolist() for c in model.clusterCenters()]
    alike = len(sizes) == 2 and abs(sizes[0] - sizes[1]) / max(sum(sizes), 1) < 0.2
    centre = [sum(x) / len(x) for x in zip(*centres, strict=True)] if alike else centres[max(range(len(sizes)), key=lambda i: sizes[i])]
    to = F.array(*[F.lit(x) for x in centre])
    away = F.aggregate(F.zip_with(vec, to, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = items.withColumn("distance", F.sqrt(away)).orderBy("distance", key).limit(shots)
    return near, centre


def silhouettes(items: DataFrame, ks: tuple[int, ...] = (2, 3, 4), vec: str = "vec", seed: int = 42) -> DataFrame:
    """(k, silhouette) by squared Euclidean distance."""
    points = items.select(array_to_vector(vec).alias("features")).persist()
    try:
        scorer = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean")
        rows = [(k, float(scorer.evaluate(KMeans(k=k, seed=seed).fit(points).transform(points)))) for k in ks]
    finally:
        points.unpersist()
    return items.sparkSession.createDataFrame(rows, "k int, silhouette double")


def nearest_ranks(items: DataFrame, by: str, distance: str, key: str, shots: int) -> DataFrame:
    """The `shots` nearest items of each group."""
    order = Window.partitionBy(by).orderBy(distance, key)
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shots)
