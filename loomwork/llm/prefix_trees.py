"""Substring de-duplication over words by prefix-partitioned suffix trees.

The suffixes that can start a repeated window are split into memory-sized groups by prefixes of variable length: the k-gram that
owns a window (see `anchors`), or the whole window where a group would be too large for a task. Each group's suffixes are sorted
by doubling the compared length, which yields the tree's levels of depth 1, 2, 4 ... and at last its nodes at the window's
depth: the deep internal nodes, which are the repeats. A node's least document keeps its window, the others lose its words.

Defined cases: a null or empty text has no words; a document without doc_id counts as larger than all others, two of them don't
remove from each other; rows with the same doc_id don't remove from each other; repeats inside one document stay; an empty table
gives no rows; other columns are ignored (`without_repeats` keeps them). Kept words are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import anchors
from loomwork.llm.shared import column_of, set_aside, text_chunks, word_bounds

GRAM_WORDS = 8


def scheme_of(window: int) -> anchors.Scheme:
    return anchors.Scheme(True, window, min(GRAM_WORDS, window))


def least_documents(window: int) -> anchors.Solver:
    def solve(contexts: list[np.ndarray], places: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contexts])
        symbols = np.concatenate(contexts)
        level, depth = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
        # a node at depth 2d is a pair of nodes at depth d; suffixes too short for the depth fall off the end
        while depth < window:
            step = min(depth, window - depth)
            pair = level[:-step] * (int(level.max()) + 1) + level[step:] if len(level) > step else level[:0]
            level = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            depth += step
        ends = np.cumsum(sizes)
        counts = sizes - window + 1
        at = anchors.ranges(ends - sizes, counts)
        node, document = level[at], np.repeat(least, counts)
        low = np.full(int(node.max()) + 1, 2**63 - 1, np.int64)
        np.minimum.at(low, node, document)
        return np.split(low[node], np.cumsum(counts)[:-1])

    return solve


def _marked(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, text, whole, runs): the windows to remove; whole: an equal text has a smaller doc_id."""
    docs = anchors.contents(docs)
    same, runs = anchors.repeated_runs(docs, scheme_of(window), least_documents(window), across=True)
    facts = same.where("copies > 1").select("h1", "h2", "rep").join(runs, ["h1", "h2"], "full_outer")
    return docs.join(facts.hint("merge"), ["h1", "h2"], "left").select("doc_id", "text", F.coalesce(F.col("order") > F.col("rep"), F.lit(False)).alias("whole"), "runs")


def _kept_words(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept words joined by one space) of each row."""
    whole, runs = column_of(batch, "whole").to_pylist(), column_of(batch, "runs").to_pylist()
    for lo, hi, data, offsets in text_chunks(column_of(batch, "text")):
        starts, ends, first = word_bounds(data, offsets)
        for r in range(lo, hi):
            s, e = starts[first[r - lo] : first[r - lo + 1]], ends[first[r - lo] : first[r - lo + 1]]
            if whole[r] and len(s) >= window:
                yield len(s), len(s), b""
                continue
            gone = anchors.covered(runs[r], window, len(s))
            s, e = s[~gone], e[~gone]
            lengths = e - s + 1
            at = anchors.ranges(s, lengths)
            at[np.cumsum(lengths) - 1] = 0
            joined = data[at] if len(at) else np.zeros(0, np.uint8)
            joined[np.cumsum(lengths) - 1] = 32
            yield len(gone), int(gone.sum()), joined[:-1].tobytes()


def substring_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _kept_words(batch, window)]
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(docs, window).mapInArrow(digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs` with the repeated words taken out of `text`; texts without any stay as they are, and rows that lose all their words go."""
    docs, restore = set_aside(docs)
    rows = docs.withColumns({"_h1": F.xxhash64(F.coalesce("text", F.lit(""))), "_h2": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    plain = anchors.contents(docs)
    same, runs = anchors.repeated_runs(plain, scheme_of(window), least_documents(window), across=True)
    facts = same.where("copies > 1").select("h1", "h2", "rep").join(runs, ["h1", "h2"], "full_outer").withColumnsRenamed({"h1": "_h1", "h2": "_h2"})
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    marked = rows.join(facts.hint("merge"), ["_h1", "_h2"], "left").withColumn("_whole", F.coalesce(order > F.col("rep"), F.lit(False))).drop("rep", "_h1", "_h2")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, whole: pa.Array, found: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts, whole, found], ["text", "whole", "runs"])
        out = [None if not gone else words.decode() if gone < n else "" for n, gone, words in _kept_words(batch, window)]
        return pa.array(out, pa.string())

    touched = F.col("_whole") | F.col("runs").isNotNull()
    # not deterministic for Catalyst, which else computes it for the filter and again for the result, by two more Python workers an executor
    kept = kept.asNondeterministic()
    new = marked.withColumn("_new", F.when(touched, kept(F.col("text"), F.col("_whole"), F.col("runs"))))
    new = new.where(F.col("_new").isNull() | (F.col("_new") != ""))
    return restore(new.withColumn("text", F.coalesce("_new", "text")))
