"""Substring de-duplication over bytes by suffix arrays that are sorted by induction.

Windows that can repeat meet in shards (see `anchors`). A shard's contexts are one string with separators. Its suffixes are classified
(smaller than their successor or not), the substrings between leftmost smaller ones are sorted by induction and named, the
string of names is sorted in the same way as long as its alphabet stays small and else by rank doubling over as many names as
a window can have, and the whole array is induced from it, bucket by bucket, each bucket as one vector operation. Common prefixes
are computed in text order (permuted): only where the preceding symbols of a suffix and its neighbour differ, as every other one is
its predecessor's less one. A window is repeated if it shares `window` bytes with a neighbour.

Defined cases: a null or empty text has no bytes; bytes are judged on whole texts, so rows with equal texts of `window` bytes
or more lose everything, whatever their doc_ids; overlapping repeats in one text count; null doc_ids are kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import anchors
from loomwork.llm.shared import column_of, span_hashes, text_chunks

GRAM_BYTES = 48
#: A string of names with more different ones than this is sorted by rank doubling.
INDUCED_ALPHABET = 2048
#: Contexts of one k-gram up to this number are sorted; of more, a task groups the windows by two hashes.
SORTED_CONTEXTS = 4096


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last symbol is the least and only one."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(following, n - 2)] > 0
    return out


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, alphabet: int) -> np.ndarray:
    """The order of all suffixes that follows from that of the leftmost smaller ones (`seeds`)."""
    n = len(text)
    size = np.bincount(text, minlength=alphabet)
    end = np.cumsum(size)
    begin = end - size
    out = np.full(n, -1, np.int64)
    seed_at = np.concatenate([[0], np.cumsum(np.bincount(text[seeds], minlength=alphabet))])
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    head = begin.copy()

    def put(found: np.ndarray, kind: bool) -> None:
        found = found - 1
        found = found[found >= 0]
        found = found[smaller[found] == kind]
        if not len(found):
            return
        symbol = text[found]
        order = np.argsort(symbol, kind="stable")
        found, symbol = found[order], symbol[order]
        new = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        counts = np.diff(np.concatenate([new, [len(symbol)]]))
        within = np.arange(len(symbol)) - np.repeat(new, counts)
        if kind:
            out[tail[symbol] - 1 - within] = found
            tail[symbol[new]] -= counts
        else:
            out[head[symbol] + within] = found
            head[symbol[new]] += counts

    symbols = np.flatnonzero(size)
    for c in symbols.tolist():
        done = begin[c]
        while done < head[c]:
            upto = head[c]
            put(out[done:upto], False)
            done = upto
        put(seeds[seed_at[c] : seed_at[c + 1]], False)
    tail = end.copy()
    for c in symbols[::-1].tolist():
        done = end[c]
        while done > tail[c]:
            upto = tail[c]
            put(out[upto:done][::-1], True)
            done = upto
        put(out[begin[c] : head[c]][::-1], True)
    out[0] = n - 1
    return out


def suffix_array(text: np.ndarray, names_deep: int) -> np.ndarray:
    """Suffixes of `text` (its last symbol 0 and nowhere else) in order; of names, only the first `names_deep` count."""
    alphabet = int(text.max()) + 1
    smaller = _smaller(text)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(left) < 2:
        return _induce(text, smaller, left, alphabet)
    rough = _induce(text, smaller, left, alphabet)
    is_left = np.zeros(len(text), bool)
    is_left[left] = True
    order = rough[is_left[rough]]
    # name the substrings from one leftmost smaller suffix to the next
    number = np.zeros(len(text), np.int64)
    number[left] = np.arange(len(left))
    last = np.concatenate([left[1:], [len(text) - 1]])
    digest = span_hashes(text.astype(np.uint64) + np.uint64(0x51ED27), left, last + 1)
    at = number[order]
    size = last - left
    new = np.concatenate([[True], (digest[at[1:]] != digest[at[:-1]]) | (size[at[1:]] != size[at[:-1]])])
    names = np.zeros(len(left), np.int64)
    names[at] = np.cumsum(new) - 1
    count = int(new.sum())
    if count < len(left):
        if count <= INDUCED_ALPHABET and names[-1] == 0 and (names == 0).sum() == 1:
            order = left[suffix_array(names, names_deep)]
        else:
            order = left[_doubled(names, names_deep)]
    return _induce(text, smaller, order, alphabet)


def _doubled(names: np.ndarray, deep: int) -> np.ndarray:
    """Suffixes of a string of names by rank doubling, until all differ or `deep` names are compared."""
    rank, width, n = names, 1, len(names)
    while True:
        key = (rank + 1) * (n + 2)
        key[:-width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if width >= deep or width >= n or rank[order[-1]] == n - 1:
            return order


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in text order, its predecessor in `order` (-1: none) and how long their common prefix is (counted to `deep` at least)."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    known = before >= 0
    at = np.flatnonzero(known)
    at = at[(at == 0) | (before[at] == 0) | (text[at - 1] != text[before[at] - 1])]
    long = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint64)
    four = long[:-3] | long[1:-2] << np.uint64(16) | long[2:-1] << np.uint64(32) | long[3:] << np.uint64(48)
    length = np.zeros(len(at), np.int64)
    live, a, b = np.arange(len(at)), at, before[at]
    while len(live):
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        x = four[a] ^ four[b]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 4, np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, "right"))
        length[live] += same
        on = (same == 4) & (length[live] < deep)
        live, a, b = live[on], a[on] + 4, b[on] + 4
    out = np.zeros(n, np.int64)
    out[at] = length
    base = np.full(n, -1, np.int64)
    base[at] = at
    base = np.maximum.accumulate(base)
    rest = np.flatnonzero(known & (base >= 0))
    out[rest] = np.maximum(out[base[rest]] - (rest - base[rest]), 0)
    return before, out


def repeat_counts(window: int) -> anchors.Solver:
    def by_array(contexts: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contexts])
        ends = np.cumsum(sizes + 1)
        text = np.ones(ends[-1] + 1, np.uint16)  # separators 1, the end 0, bytes from 2
        for c, end in zip(contexts, ends.tolist(), strict=True):
            text[end - 1 - len(c) : end - 1] = c
            text[end - 1 - len(c) : end - 1] += 2
        text[-1] = 0
        order = suffix_array(text, window)
        before, common = permuted_common_prefixes(text, order, 2 * int(sizes.max()) + 8)  # contexts differ, so none is inside a common prefix
        hit = np.flatnonzero(common >= window)
        again = np.zeros(len(text), np.int64)
        again[hit] = again[before[hit]] = 1
        return [again[end - 1 - size : end - window] for size, end in zip(sizes.tolist(), ends.tolist(), strict=True)]

    def by_hash(contexts: list[np.ndarray]) -> list[np.ndarray]:
        sizes = np.array([len(c) for c in contexts])
        ends, counts = np.cumsum(sizes), sizes - window + 1
        values = np.concatenate(contexts).astype(np.uint64)
        at = anchors.ranges(ends - sizes, counts)
        pair = np.zeros(len(at), "u8,u8")
        pair["f0"] = span_hashes(values + np.uint64(0x9F3A1), at, at + window)
        pair["f1"] = span_hashes((values + np.uint64(7)) ** np.uint64(3), at, at + window)
        _, node, often = np.unique(pair, return_inverse=True, return_counts=True)
        return np.split((often[node] > 1).astype(np.int64), np.cumsum(counts)[:-1])

    def solve(contexts: list[np.ndarray], places: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        found = by_array(contexts) if len(contexts) <= SORTED_CONTEXTS or sum(map(len, contexts)) <= 2 * anchors.BATCH_BYTES else by_hash(contexts)
        return [np.where(p > 1, 2, again + 1) for p, again in zip(places.tolist(), found, strict=True)]

    return solve


def suffix_array_digests(docs: DataFrame, window: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    docs = anchors.contents(docs)
    scheme = anchors.Scheme(False, window, min(GRAM_BYTES, window))
    same, runs = anchors.repeated_runs(docs, scheme, repeat_counts(window), across=False)
    facts = same.where("copies > 1").select("h1", "h2", F.lit(True).alias("whole")).join(runs, ["h1", "h2"], "full_outer")
    marked = docs.join(facts.hint("merge"), ["h1", "h2"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, found = column_of(batch, "whole").to_pylist(), column_of(batch, "runs").to_pylist()
            rows = []
            for lo, hi, data, offsets in text_chunks(column_of(batch, "text")):
                for r in range(lo, hi):
                    own = data[offsets[r - lo] : offsets[r - lo + 1]]
                    if whole[r] and len(own) >= window:
                        rows.append((len(own), len(own), 1, hashlib.sha256(b"").hexdigest()))
                    elif not found[r]:
                        rows.append((len(own), 0, 0, hashlib.sha256(own).hexdigest()))
                    else:
                        gone = anchors.covered(found[r], window, len(own))
                        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        rows.append((len(own), int(gone.sum()), spans, hashlib.sha256(own[~gone]).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
