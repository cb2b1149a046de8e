"""Order statistics by refinement, grid hashes, and what is fed by them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import grids
from loomwork.operators import prototypes, quantiles


def test_percentiles_of_a_class_with_most_rows(spark):
    draw = random.Random(2)
    # 90 % in one class, many ties, values that are close together beside some far away
    rows = [("big", draw.choice([0.25, 0.5, draw.random(), 1e-9 * draw.random(), 1e9 * draw.random()])) for _ in range(4_500)]
    rows += [("small", draw.random()) for _ in range(400)] + [(None, float(i)) for i in range(50)] + [("one", 7.5), ("ties", 1.0), ("ties", 1.0), ("big", None), ("void", None), ("small", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    for share in (0.5, 0.95):
        got = dict(map(tuple, quantiles.exact_percentiles(df, "g", "v", share).collect()))
        groups = {g: [v for k, v in rows if k == g and v is not None and v == v] for g, _ in rows}
        want = {g: float(np.quantile(v, share)) for g, v in groups.items() if v}
        assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-14, abs=1e-300) for g in want)


def test_order_statistics(spark):
    values = [3.0, 1.0, 1.0, -2.0, 1e300, 1e-300, 5.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    asked = spark.createDataFrame([("a", i) for i in range(-1, 9)] + [("b", 0)], "g string, rank int")
    got = {r["rank"]: r["value"] for r in quantiles.order_statistics(df, asked, "g", "v").collect()}
    assert got == dict(enumerate(sorted(values)))


def test_percentiles_of_nothing(spark):
    assert quantiles.exact_percentiles(spark.createDataFrame([], "g string, v double"), "g", "v", 0.95).count() == 0


def test_trimming_has_no_task_that_orders_a_class(spark):
    rows = [(i, "a" if i % 10 else "b", [random.Random(i).random() for _ in range(4)]) for i in range(300)]
    items = spark.createDataFrame(rows, "id int, label string, vec array<double>")
    out = prototypes.trimmed(items, "label")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "Window" not in plan
    kept_ids = {r["id"] for r in out.where("kept").select("id").collect()}
    vectors = {k: np.array([v for _, c, v in rows if c == k]) for k in "ab"}
    for k, v in vectors.items():
        distance = 1 - v @ (np.floor(v * 1e6).sum(0) / 1e6 / len(v))
        mine = [i for i, c, _ in rows if c == k]
        assert kept_ids & set(mine) == {i for i, d in zip(mine, distance, strict=True) if d <= np.quantile(distance, 0.95) + 1e-12}
    mean = {r["cls"]: r["vec"] for r in prototypes.trimmed_mean(items, "label").collect()}
    kept = [v for (i, c, v) in rows if c == "a" and i in kept_ids]
    assert mean["a"] == pytest.approx(list(np.mean(kept, 0)), abs=2e-6)


# ---- hashes of grids


def bits(flags):
    value = sum(1 << i for i, f in enumerate(flags) if f)
    return value - (1 << 64) if value >> 63 else value


def test_transforms_are_the_textbook_ones(spark):
    draw = np.random.default_rng(4)
    picture = draw.random((16, 16))
    df = spark.createDataFrame([(picture.ravel().tolist(),)], "g array<double>")
    got = df.select(grids.transformed(F.col("g"), grids.cosine_matrix(16)).alias("c"), grids.transformed(F.col("g"), grids.haar_matrix(16, 1)).alias("h")).first()
    k = np.arange(16)
    cosine = [[4 * sum(picture[r, c] * np.cos(np.pi * u * (2 * r + 1) / 32) * np.cos(np.pi * v * (2 * c + 1) / 32) for r in k for c in k) for v in k] for u in k]
    assert np.allclose(np.reshape(got["c"], (16, 16)), cosine)
    low = picture.reshape(8, 2, 8, 2).sum((1, 3)) / 2
    assert np.allclose(np.reshape(got["h"], (16, 16))[:8, :8], low)


def test_hashes_of_larger_and_odd_grids(spark):
    draw = np.random.default_rng(5)
    pictures = [draw.random((32, 32)), np.round(draw.random((32, 32)), 1), np.zeros((32, 32))]
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(pictures)] + [(3, None), (4, []), (5, [1.0] * 7), (6, [None] * 1024)], "id int, g array<double>")
    got = {r["id"]: r for r in df.select("id", grids.cosine_hash(F.col("g"), 32).alias("c"), grids.wavelet_hash(F.col("g"), 32, 2).alias("w")).collect()}
    n = np.arange(32)
    matrix = 2 * np.cos(np.pi * n[:, None] * (2 * n[None] + 1) / 64)
    for i in (0, 1):
        low = (matrix @ pictures[i] @ matrix.T)[:8, :8].ravel()
        assert got[i]["c"] == bits(low > np.median(low))
        small = pictures[i].reshape(8, 4, 8, 4).sum((1, 3)).ravel()
        assert got[i]["w"] == bits(small > np.median(small) + 1e-9)
    assert got[2]["c"] == got[2]["w"] == 0 and all(got[i]["c"] is None and got[i]["w"] is None for i in (3, 4, 5))
    assert got[6]["c"] in (0, None)


def test_gradient_hash(spark):
    rows = [(0, [1.0, 2.0, 1.0, 5.0, 5.0, 6.0]), (1, None), (2, [1.0] * 5), (3, [])]
    df = spark.createDataFrame(rows, "id int, g array<double>")
    got = {r["id"]: r["h"] for r in df.select("id", grids.gradient_hash(F.col("g"), 3).alias("h")).collect()}
    assert got == {0: 0b1001, 1: None, 2: None, 3: None}

