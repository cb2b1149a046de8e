"""Writers read back, read-through tables, decoding without Pillow, and clustering against numpy."""

import csv
import json

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomwork.functions import paths
from loomwork.operators import ensemble, metrics, prototypes, sampling
from loomwork.sources import images, sinks


@pytest.fixture
def samples(spark):
    rows = spark.createDataFrame([("1", "a/ü.jpg", "Is it a 吉他?", "Yes", "x"), ("2", "b.jpg", "Is it?", "No", None)], "i string, p string, q string, a string, s string")
    sample = sampling.conversation(F.col("i"), F.col("p"), F.col("q"), F.col("a"), F.col("s"))
    return rows.select(F.inline(F.array(sample)))


def test_samples_as_json_lines(spark, samples, tmp_path):
    for kept in (False, True):
        sinks.write_samples(samples, str(tmp_path / "s"), kept)  # the second time over the first
        back = spark.read.json(str(tmp_path / "s"))
        assert ("metadata" in back.columns) == kept
        assert sorted((r["id"], r["image"], r["conversations"][0]["value"], r["conversations"][1]["from"]) for r in back.collect()) == [("1", "a/ü.jpg", "Is it a 吉他?", "gpt"), ("2", "b.jpg", "Is it?", "gpt")]


def test_samples_as_one_array(samples):
    got = json.loads(sinks.samples_array(samples))
    assert sorted(x["id"] for x in got) == ["1", "2"] and got[0]["conversations"][0]["from"] == "human" and "吉他" in sinks.samples_array(samples, indent=False)
    with pytest.raises(ValueError):
        sinks.samples_array(samples, max_rows=1)


def test_metrics_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.12345, 3), ("b", 2.0, 4)], "cls string, f1 double, n int")
    sinks.write_csv(rows, str(tmp_path / "one"))
    sinks.write_csv(rows, str(tmp_path / "by"), by="cls", places=1)
    lines = [r for p in (tmp_path / "one").glob("part-*") for r in csv.DictReader(p.open())]
    assert sorted(r["f1"] for r in lines) == ["0.123", "2.000"] and lines[0].keys() == {"cls", "f1", "n"}
    assert sorted(p.name for p in (tmp_path / "by").iterdir() if p.is_dir()) == ["cls=a", "cls=b"]
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "by")).select("cls", "f1", "n").collect())) == [("a", "0.1", "3"), ("b", "2.0", "4")]


def test_summary_with_average_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.5, 1.0), (1, 1.0, 0.0)], "cls int, precision double, recall double")
    sinks.write_csv(metrics.with_average(rows, "cls", ["precision", "recall"]), str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "s")).collect())) == [("0", "0.500", "1.000"), ("1", "1.000", "0.000"), ("Average", "0.750", "0.500")]


def test_features_are_written_by_class_and_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(i, "ab"[i % 2], [float(i), 0.5]) for i in range(6)], "id int, label string, vec array<double>")
    sinks.write_features(rows, str(tmp_path / "f"))
    some = spark.read.parquet(str(tmp_path / "f")).where("label = 'a'")
    assert sorted((r["id"], r["vec"]) for r in some.collect()) == [(i, [float(i), 0.5]) for i in (0, 2, 4)]
    assert "PartitionFilters: [isnotnull(label" in some._jdf.queryExecution().executedPlan().toString()


def test_read_through_computes_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert images.read_through(spark, str(tmp_path / "t"), compute).count() == 3
    assert len(calls) == 1


def test_images_that_cannot_be_read_are_dropped(spark, tmp_path):
    rows = spark.createDataFrame([("p", "cat"), ("q", "error")], "path string, label string")
    assert [r["path"] for r in images.readable(rows).collect()] == ["p"]
    got = images.encoded(rows, lambda batch: [[float(len(p))] for p in batch["path"]]).collect()
    assert [r["vec"] for r in got] == [[1.0], [1.0]]
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat/broken.jpg").write_bytes(b"no image")
    files = images.image_files(spark, str(tmp_path), content=True)
    try:
        import PIL  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="Pillow"):
            images.decoded(files)
    else:
        assert [r["label"] for r in images.decoded(files).collect()] == ["error"]


def test_marks(spark):
    rows = spark.createDataFrame([(0.5,), (0.4,), (None,)], "s double")
    assert [r[0] for r in rows.select(paths.pass_mark(F.col("s"), F.lit(0.5))).collect()] == ["yes", "no", "no"]


def clouds(spark, sizes):
    draw = np.random.default_rng(3)
    points = np.concatenate([draw.normal(5 * i, 0.5, (n, 3)) for i, n in enumerate(sizes)])
    return points, spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id int, vec array<double>")


@pytest.mark.parametrize("sizes", [(30, 10), (21, 19)])
def test_clustered_prototype(spark, sizes):
    """The centre of the larger cluster, or of two like ones the centres' mean; the nearest items by distance, then key."""
    points, items = clouds(spark, sizes)
    items = items.union(items.where("id = 0").withColumn("id", F.lit(-1)))  # a tie
    points = np.concatenate([points, points[:1]])
    ids = np.array([*range(sum(sizes)), -1])
    centres = [points[(ids >= 0) & (ids < sizes[0]) | (ids == -1)].mean(0), points[(ids >= sizes[0])].mean(0)]
    want = np.mean(centres, 0) if sizes[0] - sizes[1] < 8 else centres[0]
    near, centre = prototypes.clustered_prototype(items, "id", 5)
    assert np.allclose(centre, want, atol=1e-9)
    far = np.sqrt(((points - want) ** 2).sum(1))
    best = sorted(zip(np.round(far, 12), ids, strict=True))[:5]
    assert [(r["id"], pytest.approx(r["distance"])) for r in near.orderBy("distance", "id").collect()] == [(int(i), d) for d, i in best]


def test_silhouettes(spark):
    points, items = clouds(spark, (12, 9, 7))
    got = {r["k"]: r["silhouette"] for r in prototypes.silhouettes(items).collect()}
    features = items.select("id", array_to_vector("vec").alias("features"))
    apart = ((points[:, None] - points[None]) ** 2).sum(2)
    for k in (2, 3, 4):
        cluster = np.array([r["prediction"] for r in KMeans(k=k, seed=42).fit(features).transform(features).orderBy("id").collect()])
        values = []
        for i, c in enumerate(cluster):
            own = (cluster == c).sum()
            inside = apart[i][cluster == c].sum() / max(own - 1, 1)
            outside = min(apart[i][cluster == d].mean() for d in set(cluster) - {c})
            values.append(0.0 if own == 1 else (outside - inside) / max(inside, outside))
        assert got[k] == pytest.approx(np.mean(values), abs=1e-9)


def test_nearest_ranks_with_ties(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.5), (3, "a", 0.1), (4, "b", 9.0)], "id int, g string, d double")
    assert sorted((r["g"], r["rank"], r["id"]) for r in prototypes.nearest_ranks(rows, "g", "d", "id", 2).collect()) == [("a", 1, 3), ("a", 2, 1), ("b", 1, 4)]


def test_cache_keys_of_several_epochs(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0, 7), (1, [0.0, 3.0], 1, 9), (2, [2.0, 0.0], 0, 5)], "id int, vec array<double>, epoch int, label int")
    got = {r["key_id"]: (r["label"], r["vec"]) for r in prototypes.cache_keys(rows, "id", "label").collect()}
    assert got[1][0] == 7 and got[1][1] == pytest.approx([0.5 / np.hypot(0.5, 1.5), 1.5 / np.hypot(0.5, 1.5)]) and got[2] == (5, [1.0, 0.0])


def test_union_of_models_counts_repeated_names_once(spark):
    scores = spark.createDataFrame([(0, "n", "a/n", 0.9), (0, "n", "b/n", 0.1)], "cls int, name string, path string, sim double")
    limits = spark.createDataFrame([(0, 0.5)], "cls int, threshold double")
    row = ensemble.passes(scores, limits, "cls", "name", [], "en").collect()
    assert [(r["en_sim"], r["en_pass"], r["en_path"]) for r in row] == [(0.1, False, "b/n")]
