"""Helpers that several operators use: checkpoints, Arrow text chunks, vectorised word hashing, linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.storage import checkpointed

#: Bytes of text that one vectorised step takes at once; a longer document is one step of its own.
CHUNK_BYTES = 1 << 20


def set_aside(docs: DataFrame, used: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all but the used columns renamed, so that they can't clash with an operator's own, and what puts names and order back."""
    names = docs.columns
    inner = [c if c in used else f"_aside{i}" for i, c in enumerate(names)]

    def restore(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(a).alias(b) for a, b in zip(inner, names, strict=True)])

    return docs.toDF(*inner), restore


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them); a null text counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n-1 modulo 2**64."""
    known = _powers[base]
    while len(known) < n:
        step = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * step])
    if len(known) <= 4 * CHUNK_BYTES:
        _powers[base] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end] for every span, from one running sum."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    inverse = powers(_BASE_INVERSE, len(values) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes that aren't `apart`, by default `[^\\x20\\x09-\\x0D]+`), and the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, and the first word of each row."""
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(_BYTE_VALUES[data], starts, ends), starts, ends, first


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of values[i:i+k] for every i; rows aren't looked at here."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return span_hashes(values, at, at + k)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def linked_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges (a long, b long) to (node long, component long), the smallest node.

    Alternates large-star and small-star steps until every node has one smaller neighbour or only larger ones; one grouping tells
    that, so a graph that is so from the start takes no step. Every step is a grouping with partial aggregation and a join
    that Spark may split, so a node with very many neighbours doesn't meet in one task.
    Self-loops are allowed and keep a single node in the result. Null ends are dropped.
    """
    both = edges.where("a is not null and b is not null")
    both = checkpointed(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now = both.where("a <> b")
    for _ in range(rounds):
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = F.count(F.when(F.col("b") < F.col("a"), 1))
        if ways.groupBy("a").agg(smaller.alias("s"), F.count("*").alias("n")).where("s > 1 or (s = 1 and n > 1)").isEmpty():
            break
        # large star: each larger neighbour of u points at the smallest node of u's neighbourhood
        low = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = ways.join(low, ways.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        kept = large.join(low, large.a == low.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(kept.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    found = ways.unionByName(both.where("a = b")).groupBy("a").agg(F.min("b").alias("m"))
    return found.select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
