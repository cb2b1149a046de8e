"""The trained adapter against the same steps in plain numpy, broken runs, limits."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import adapter, bounded, prototypes
from loomwork.plans import similarity


def plain_training(x, y, ids, keys, labels, protos, settings, test_x, test_y, classes):
    """Loss, mean best F1 and keys of every epoch."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    folder = np.array([int(md5(str(i))[:8], 16) % adapter.FOLDERS for i in ids])
    hot = np.eye(len(protos))[labels]
    first, second, history = np.zeros_like(keys), np.zeros_like(keys), []

    def logits(v, k):
        heat = np.exp(-(settings.beta - settings.beta * v @ k.T))
        return 100 * v @ protos.T + settings.alpha * 10 * heat @ hot, heat

    for epoch in range(settings.epochs):
        order = sorted(range(adapter.FOLDERS), key=lambda f: (md5(f"{settings.seed}:{epoch}:{f}"), f))
        losses = []
        for i in range(settings.steps):
            mine = np.isin(folder, order[i :: settings.steps])
            z, heat = logits(x[mine], keys)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            losses += (-np.log(p[np.arange(mine.sum()), y[mine]])).tolist()
            p[np.arange(mine.sum()), y[mine]] -= 1
            g = (p[:, labels] * heat * settings.alpha * 10 * settings.beta).T @ x[mine] / max(mine.sum(), 1)
            t = epoch * settings.steps + i + 1
            rate = settings.rate * (1 + math.cos(math.pi * (t - 1) / (settings.epochs * settings.steps))) / 2
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            keys = keys - rate * settings.decay * keys - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-4)
        z, _ = logits(test_x, keys)
        best = []
        for c in classes:
            pos, neg = z[test_y == c, c], z[test_y != c, c]
            lo, hi = max(pos.min(), neg.min()), min(pos.max(), neg.max())
            f1 = 0.0
            for at in np.linspace(lo, hi, max(int((hi - lo) * 10), 0)):
                tp, fp, fn = (pos >= at).sum(), (neg >= at).sum(), (pos < at).sum()
                if tp:
                    a, b = tp / (tp + fp), tp / (tp + fn)
                    f1 = max(f1, 2 * a * b / (a + b))
            best.append(f1)
        history.append((np.mean(losses), np.mean(best), keys))
    return history


def test_epochs_and_winner_are_those_of_plain_numpy(spark, small):
    shots, rest = similarity._split(spark, small, "all")
    cache = {r["vec_id"]: r for r in shots.collect()}
    others = rest.collect()
    protos = np.array([r["vec"] for r in prototypes.centroids(shots, "label").orderBy("cls").collect()])
    ids = sorted(cache)
    x, y = np.array([cache[i]["vec"] for i in ids]), np.array([cache[i]["label"] for i in ids])
    want = plain_training(x, y, ids, x.copy(), y, protos, similarity.TRAINING, np.array([r["vec"] for r in others]), np.array([r["label"] for r in others]), range(similarity.TARGETS))
    got = sorted(map(tuple, similarity.adapter_epochs(spark, small).collect()))
    assert [r[0] for r in got] == list(range(similarity.TRAINING.epochs))
    assert [r[1] / 1e6 for r in got] == pytest.approx([w[0] for w in want], abs=2e-6)
    assert [r[2] / 1e6 for r in got] == pytest.approx([w[1] for w in want], abs=2e-6)
    assert [r[3] for r in got].index(True) == int(np.argmax([w[1] for w in want])) and sum(r[3] for r in got) == 1
    assert want[-1][0] < want[0][0]


@pytest.fixture
def small_case(spark):
    rows = [(i, [1.0, 0.1 * i], 0) for i in range(5)] + [(9 + i, [0.1 * i, 1.0], 1) for i in range(5)]
    data = spark.createDataFrame(rows, "id int, vec array<double>, label int")
    cache = spark.createDataFrame([(0, [0.6, 0.8], 0), (1, [0.8, 0.6], 1)], "key_id int, vec array<double>, label int")
    return data, cache, spark.createDataFrame([(0, [0.7, 0.7]), (1, [0.7, 0.7])], "cls int, vec array<double>")


def test_a_broken_run_goes_on(small_case, tmp_path):
    data, cache, protos = small_case
    settings = adapter.Training(rate=0.05, epochs=3, steps=2)
    scores = iter([0.5, 0.9, 0.9])
    whole, history = adapter.train_adapter(data, "id", cache, protos, lambda m: next(scores), settings)
    assert history[-1]["loss"] < history[0]["loss"] and [h["f1"] for h in history] == [0.5, 0.9, 0.9] and history[-1]["rate"] == pytest.approx(0)

    def failing(scores):
        for s in scores:
            yield s
        raise KeyboardInterrupt

    state, calls = str(tmp_path / "state"), []
    broken = failing([0.5])

    def score(model):
        calls.append(1)
        return next(broken)

    with pytest.raises(KeyboardInterrupt):
        adapter.train_adapter(data, "id", cache, protos, score, settings, state)
    rest = iter([0.9, 0.9])
    again, later = adapter.train_adapter(data, "id", cache, protos, lambda m: next(rest), settings, state)
    assert np.allclose(again.keys, whole.keys, atol=1e-12) and [h["loss"] for h in later] == pytest.approx([h["loss"] for h in history])
    # nothing is left to do: no epoch is scored again, and other settings are refused
    done, _ = adapter.train_adapter(data, "id", cache, protos, lambda m: 1 / 0, settings, state)
    assert np.allclose(done.keys, whole.keys)
    with pytest.raises(ValueError):
        adapter.train_adapter(data, "id", cache, protos, lambda m: 0.0, adapter.Training(rate=0.1, epochs=3, steps=2), state)


def test_the_best_epoch_is_the_first_of_equal_ones(small_case):
    data, cache, protos = small_case
    seen = []

    def score(model):
        seen.append(model.keys.copy())
        return 0.25

    best, _ = adapter.train_adapter(data, "id", cache, protos, score, adapter.Training(epochs=2, steps=1, rate=0.1))
    assert np.array_equal(best.keys, seen[0]) and not np.array_equal(seen[0], seen[1])


def test_every_row_is_in_one_step_of_an_epoch():
    settings = adapter.Training(steps=5)
    for epoch in (0, 1):
        assert sorted(f for step in adapter.dealt_folders(settings, epoch) for f in step) == list(range(adapter.FOLDERS))
    assert adapter.dealt_folders(settings, 0) != adapter.dealt_folders(settings, 1)


@pytest.mark.parametrize("side", ["keys", "classes"])
def test_large_models_are_refused(spark, small_case, monkeypatch, side):
    data, cache, protos = small_case
    monkeypatch.setattr(adapter, "MAX_ROWS", 2)
    more = spark.createDataFrame([(2, [0.1, 0.2], 0)], "key_id int, vec array<double>, label int")
    with pytest.raises(ValueError, match="more than 2"):
        adapter.first_adapter(cache.union(more) if side == "keys" else cache, protos.union(more.select("key_id", "vec")) if side == "classes" else protos, adapter.Training())
    assert bounded.MAX_ROWS > 2


def test_gradients_of_many_tasks(spark, small_case):
    data, cache, protos = small_case
    model = adapter.first_adapter(cache, protos, adapter.Training())
    one, loss, n = adapter._gradient(data.coalesce(1), model)
    many, loss_, n_ = adapter._gradient(data.repartition(40), model)
    assert np.allclose(one, many) and loss == pytest.approx(loss_) and n == n_ == 10
    assert adapter._gradient(data.where(F.lit(False)), model)[1:] == (0.0, 0)
