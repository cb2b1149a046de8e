"""A few-shot adapter: cache keys that are trained further by gradient steps, their sums made by Spark.

The keys (at most `bounded.MAX_ROWS`) are the model; rows stay where they are. Rows are written once in folders by a hash of their key,
and an epoch deals these folders to its steps in an order of its own, so a step reads only its share of the rows and every run takes
the same steps. In a step each Arrow batch gives its gradient by the keys, sums of `FAN_IN` tasks are joined by others, and what comes
back is a bounded number of matrices as small as the keys. AdamW follows, at a rate that falls as a cosine over all steps.

After each epoch the model is scored by the mean over the classes of the best F1 on the range where their scores overlap; the best
epoch is the result (of equal ones the first). With a folder for the state, keys and moments of every epoch are kept there, and a run
that broke off goes on after its last whole epoch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import scoring, sweep
from loomwork.operators.bounded import MAX_ROWS
from loomwork.storage import exists, stored

#: Folders that the rows are dealt to: the steps of an epoch can't be more.
FOLDERS = 64
#: Tasks whose gradients one other task adds up.
FAN_IN = 16


@dataclass(frozen=True)
class Training:
    """How an adapter is trained; `steps` of an epoch share its rows."""

    alpha: float = 1.0
    beta: float = 5.5
    rate: float = 1e-3
    epochs: int = 20
    steps: int = 4
    decay: float = 0.01
    epsilon: float = 1e-4
    seed: str = "adapter"

    def rate_at(self, step: int) -> float:
        return self.rate * 0.5 * (1 + math.cos(math.pi * step / (self.epochs * self.steps)))


@dataclass
class Adapter:
    key_ids: np.ndarray
    keys: np.ndarray  # (n_keys, dim)
    labels: np.ndarray  # class of each key
    prototypes: np.ndarray  # (n_classes, dim)
    alpha: float
    beta: float

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Combined logits, and the keys' activations."""
        heat = np.exp(-(self.beta - self.beta * (x @ self.keys.T)))
        hot = np.eye(len(self.prototypes))[self.labels]
        return 100.0 * x @ self.prototypes.T + self.alpha * 10 * heat @ hot, heat

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Summed gradient of the cross-entropy by the keys, and the summed loss."""
        logits, heat = self.logits(x)
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
        p[np.arange(len(y)), y] -= 1
        return (p[:, self.labels] * heat * (self.alpha * 10 * self.beta)).T @ x, loss

    def as_table(self, spark: SparkSession) -> DataFrame:
        """(key_id, vec, label)."""
        rows = [(int(i), v.tolist(), int(c)) for i, v, c in zip(self.key_ids, self.keys, self.labels, strict=True)]
        return spark.createDataFrame(rows, "key_id long, vec array<double>, label int")


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 0))


def _small(df: DataFrame, order: str, what: str) -> pd.DataFrame:
    rows = df.orderBy(order).limit(MAX_ROWS + 1).toPandas()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} {what}")
    return rows


def first_adapter(cache: DataFrame, prototypes: DataFrame, settings: Training) -> Adapter:
    """The adapter that the cache keys (key_id, vec, label) are; prototypes: (cls, vec) with classes 0, 1, ..."""
    keys, classes = _small(cache, "key_id", "cache keys"), _small(prototypes, "cls", "classes")
    return Adapter(keys["key_id"].to_numpy(np.int64), _stack(keys["vec"]), keys["label"].to_numpy(int), _stack(classes["vec"]), settings.alpha, settings.beta)


def dealt_folders(settings: Training, epoch: int) -> list[list[int]]:
    """The folders of each step of an epoch."""
    order = sorted(range(FOLDERS), key=lambda f: (_md5(f"{settings.seed}:{epoch}:{f}"), f))
    return [order[i :: settings.steps] for i in range(settings.steps)]


def _md5(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


def folder_of(key: str):
    """The folder of a row, from its key."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(FOLDERS)).cast("int")


def _gradient(rows: DataFrame, model: Adapter) -> tuple[np.ndarray, float, int]:
    """The mean gradient over rows (vec, label), the mean loss and the number of rows."""
    shape = model.keys.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total, loss, n = np.zeros(shape), 0.0, 0
        for batch in batches:
            if len(batch):
                g, more = model.gradient(_stack(batch["vec"]), batch["label"].to_numpy(int))
                total, loss, n = total + g, loss + more, n + len(batch)
        if n:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() // FAN_IN], "at": [TaskContext.get().partitionId()], "g": [total.tobytes()], "loss": [loss], "n": [n]})

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("at")
        total = np.zeros(shape)
        for g in parts["g"]:
            total += np.frombuffer(g).reshape(shape)
        return pd.DataFrame({"part": parts["part"][:1], "g": [total.tobytes()], "loss": [parts["loss"].sum()], "n": [parts["n"].sum()]})

    tasks = rows.select("vec", "label").mapInPandas(sums, "part long, at long, g binary, loss double, n long")
    parts = tasks.groupBy("part").applyInPandas(joined, "part long, g binary, loss double, n long").toPandas().sort_values("part")
    n = int(parts["n"].sum()) if len(parts) else 0
    total = sum((np.frombuffer(g).reshape(shape) for g in parts["g"]), np.zeros(shape))
    return total / max(n, 1), float(parts["loss"].sum()) / max(n, 1), n


def mean_best_f1(items: DataFrame, prototypes: DataFrame, keys: DataFrame, settings: Training, classes: DataFrame) -> float:
    """The mean over `classes` (cls) of the best F1 on the range where a class's combined logits overlap with those of the rest. items: (vec, label)."""
    scored = scoring.with_affinities(scoring.class_scores(items.select("vec", "label"), prototypes), keys).drop("vec")
    cached = scored.withColumn("_cached", scoring.cache_logits(F.transform("scores", lambda s: s["cls"]), F.lit(settings.beta)))
    long = cached.select("label", F.inline(scoring.combined_logits(F.lit(settings.alpha), F.col("_cached")))).join(F.broadcast(classes), "cls")
    # stored, as the range of the scores is found before they are counted
    best = sweep.best_or_zero(sweep.overlap_sweep(stored(long), ["cls"], F.col("label") == F.col("cls")), ["cls"], classes)
    return float(best.agg(F.avg("f1")).first()[0] or 0.0)


def _save(spark: SparkSession, path: str, model: Adapter, first: np.ndarray, second: np.ndarray, facts: dict) -> None:
    rows = [(int(i), k.tolist(), m.tolist(), v.tolist(), json.dumps(facts)) for i, k, m, v in zip(model.key_ids, model.keys, first, second, strict=True)]
    spark.createDataFrame(rows, "key_id long, vec array<double>, first array<double>, second array<double>, facts string").coalesce(1).write.mode("overwrite").parquet(path)


def train_adapter(
    rows: DataFrame, key: str, cache: DataFrame, prototypes: DataFrame, score: Callable[[Adapter], float], settings: Training | None = None, state: str | None = None
) -> tuple[Adapter, list[dict]]:
    """The best epoch's adapter, and of each epoch its number, mean loss, rate after it and `f1`, what `score` says of it.

    rows: (key, vec, label), cache: (key_id, vec, label), prototypes: (cls, vec) of classes 0, 1, ... `state` is a folder that all
    executors share; settings other than those it was made with are an error.
    """
    settings = settings or Training()
    spark = rows.sparkSession
    if not 1 <= settings.steps <= FOLDERS:
        raise ValueError(f"an epoch has 1 to {FOLDERS} steps")
    model = first_adapter(cache, prototypes, settings)
    first, second = np.zeros_like(model.keys), np.zeros_like(model.keys)
    history, best = [], (-1.0, model.keys)
    dealt = stored(rows.select("vec", F.col("label").cast("int").alias("label"), folder_of(key).alias("folder")), by=["folder"])
    for epoch in range(settings.epochs):
        path = f"{state}/epoch-{epoch:04d}" if state else None
        if path and exists(spark, f"{path}/_SUCCESS"):
            kept = spark.read.parquet(path).orderBy("key_id").toPandas()
            facts = json.loads(kept["facts"][0])
            if facts.pop("settings") != asdict(settings) or kept["key_id"].tolist() != model.key_ids.tolist():
                raise ValueError(f"{path} was made with other settings or keys")
            model.keys, first, second = _stack(kept["vec"]), _stack(kept["first"]), _stack(kept["second"])
        else:
            losses = []
            for i, folders in enumerate(dealt_folders(settings, epoch)):
                step = epoch * settings.steps + i
                gradient, loss, n = _gradient(dealt.where(F.col("folder").isin(folders)), model)
                if n:
                    losses.append((loss, n))
                rate = settings.rate_at(step)
                first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
                moved = (first / (1 - 0.9 ** (step + 1))) / (np.sqrt(second / (1 - 0.999 ** (step + 1))) + settings.epsilon)
                model = Adapter(model.key_ids, model.keys * (1 - rate * settings.decay) - rate * moved, model.labels, model.prototypes, settings.alpha, settings.beta)
            mean = sum(x * n for x, n in losses) / max(sum(n for _, n in losses), 1)
            facts = {"epoch": epoch, "loss": mean, "rate": settings.rate_at((epoch + 1) * settings.steps), "f1": score(model)}
            if path:
                _save(spark, path, model, first, second, facts | {"settings": asdict(settings)})
        history.append(facts)
        if facts["f1"] > best[0]:
            best = facts["f1"], model.keys
    return Adapter(model.key_ids, best[1], model.labels, model.prototypes, settings.alpha, settings.beta), history
