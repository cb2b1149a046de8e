"""Greedy clusters against the sequential walk, also where hashes are near very many others, stretches are short and lists are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import dedup, near_pairs

HASHES = ["a", "b", "c"]


def walk(rows, distance):
    """{key: key of the first representative near it} of rows (key, size, *hashes), larger ones first."""
    want, kept = {}, []
    for key, _, *h in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[key] = next((k for k, other in kept if any(((x ^ y) & ((1 << 64) - 1)).bit_count() <= distance for x, y in zip(h, other, strict=True))), None)
        if want[key] is None:
            kept.append((key, h))
    return want


def sparse(draw, bits, most):
    value = sum(1 << i for i in draw.sample(range(bits), draw.randrange(most + 1)))
    return value - (1 << 64) if value >> 63 else value


def clusters(spark, rows, distance, **limits):
    df = spark.createDataFrame(rows, "id long, size int, a long, b long, c long")
    got = [tuple(r) for r in dedup.greedy_clusters(df, "id", HASHES, [-F.col("size")], distance, **limits).collect()]
    assert len(got) == len(rows)
    return dict(got)


@pytest.mark.parametrize("limits", [{}, {"stretch": 16}, {"stretch": 1, "listed": 2}, {"stretch": 40, "listed": 3, "walked": 0}, {"stretch": 500, "listed": 1}, {"stretch": 90, "listed": 2, "walked": 30}])
def test_any_stretches_and_lists_give_the_walk(spark, limits):
    draw = random.Random(5)
    rows = [(i, draw.randrange(6), *[sparse(draw, 64, 9) for _ in HASHES]) for i in range(260)]
    rows += [(1000 + i, draw.randrange(6), *r[2:]) for i, r in enumerate(rows[:40])]
    assert clusters(spark, rows, 5, **limits) == walk(rows, 5)


@pytest.mark.parametrize("distance", [0, 1, 9])
def test_other_distances(spark, distance):
    draw = random.Random(distance)
    rows = [(i, draw.randrange(3), *[sparse(draw, 64, 7 + distance) for _ in HASHES]) for i in range(120)]
    assert clusters(spark, rows, distance, stretch=20) == walk(rows, distance)


def test_items_without_a_hash_and_none_at_all(spark):
    rows = [(1, 2, 5, 6, 7), (2, 1, 5, None, 7), (3, 1, 4, 900, 99999)]
    assert clusters(spark, rows, 5) == {1: None, 2: None, 3: 1}
    assert clusters(spark, rows[:0], 5) == {}


def test_hashes_near_all_others_make_no_square(spark, monkeypatch):
    draw = random.Random(1)
    values = set()
    while len(values) < 9000:
        values.add(sparse(draw, 64, 3))
    rows = [(i, 1, v, v, v) for i, v in enumerate(sorted(values, key=lambda v: (v & ((1 << 64) - 1)) * 0x9E3779B97F4A7C15 % (1 << 64)))]
    made, keep = [], dedup.checkpointed

    def counted(df):
        df = keep(df)
        made.append(df.count())
        return df

    monkeypatch.setattr(dedup, "checkpointed", counted)
    got = clusters(spark, rows, 5)
    names = sorted(i for i, first in got.items() if first is None)
    reps = set(names)
    h = np.array([r[2] for r in rows]).view(np.uint64)
    near = np.bitwise_count(h[:, None] ^ h[names]) <= 5
    assert all(got[i] == (None if i in reps else names[int(near[i].argmax())]) for i in range(len(rows)))
    # the walk goes by key: before its own place, a representative is near no other
    assert all(near[i].sum() == 1 for i in reps) and all(got[i] is None or got[i] < i for i in got)
    assert max(made) < 5_000_000  # not the 40 million pairs


def test_places_and_blocks_of_any_size(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(2)
    place = np.sort(draw.integers(0, 40, 600))
    place[200:380] = place[200]
    h, item = draw.integers(-9, 9, 600), draw.permutation(600)
    whole = list(near_pairs._whole_places([pa.RecordBatch.from_arrays([pa.array(x) for x in (place, h, item)], list("phi"))]))
    monkeypatch.setattr(near_pairs, "ROWS", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 30]) for x in (place, h, item)], list("phi")) for i in range(0, 600, 30)]
    got = list(near_pairs._whole_places(batches))
    assert len(got) > 3 and not any(a[0][-1] == b[0][0] for a, b in zip(got, got[1:], strict=False))
    assert all((np.concatenate([g[i] for g in got]) == whole[0][i]).all() for i in range(3))
    monkeypatch.setattr(near_pairs, "BLOCK", 7)
    rows, begin, count = np.array([3, 5, 6, 9]), np.array([0, 0, 4, 1]), np.array([3, 5, 0, 8])
    blocks = list(near_pairs._pairs(rows, begin, count))
    assert [(a, b) for x, y in blocks for a, b in zip(x.tolist(), y.tolist(), strict=True)] == [(r, b + i) for r, b, n in zip(rows.tolist(), begin.tolist(), count.tolist(), strict=True) for i in range(n)]
    assert len(blocks) == 3
