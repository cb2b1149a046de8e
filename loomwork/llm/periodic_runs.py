"""Periodic runs: stretches of words that repeat with a fixed period, found by probing a grid for each period.

A run of period p has at least `exponent` (4) times p words, so the words that equal the one p places on are at least 3p in a row
and three neighbouring grid points jp, (j+1)p, (j+2)p lie among them. For every p only those places are compared, n/p of n words,
so all periods together take n times a harmonic sum. Three hits in a row are a survivor; it is extended to both sides by comparing
chunks of the words with the words p places on. Periods are probed from the smallest up, and grid points inside a run that is
found already are passed over: a stretch that a smaller period explains would be found again with each of its multiples.
Words are compared by 64-bit hashes; the words of every run are then compared byte by byte, and if two differ, the texts are
done again with numbers in place of hashes.

Work is done on about 1 MB of text, or one document, at once and `PROBES` grid points at once.

Defined cases: a null text has no words; a text without a run is kept as its words joined by one space; a null doc_id stays null
(and gets no planted loop); repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import ranges, text_chunks, word_hashes

#: Grid points that are compared at once.
PROBES = 1 << 20


def _differs(values: np.ndarray, at: int, step: int, stop: int, period: int) -> int:
    """The first place from `at` on (by `step`, 1 or -1, before `stop`) whose value isn't the one `period` places on; chunks grow."""
    size = 64
    while (stop - at) * step > 0:
        end = at + step * min(size, abs(stop - at))
        lo, hi = (at, end) if step > 0 else (end + 1, at + 1)
        same = values[lo:hi] == values[lo + period : hi + period]
        if not same.all():
            wrong = np.flatnonzero(~same)
            return lo + int(wrong[0] if step > 0 else wrong[-1])
        at, size = end, min(2 * size, PROBES)
    return stop


def _period_blocks(lengths: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and periods to probe, smaller periods first; blocks have about PROBES grid points, or one period."""
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    periods = np.arange(1, int(sizes[0]) // exponent + 1) if len(sizes) else np.zeros(0, np.int64)
    rows = np.searchsorted(-sizes, -exponent * periods, "right")  # so many of the longest rows can have a run of this period
    block = np.cumsum(np.concatenate([[0], np.cumsum(sizes)])[rows] // np.maximum(periods, 1)) // PROBES
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            yield order[ranges(np.zeros(len(part), np.int64), rows[part])], np.repeat(periods[part], rows[part])


def word_runs(values: np.ndarray, first: np.ndarray, exponent: int = 4, least: int = 6) -> np.ndarray:
    """(row, start, length, period) of every maximal run, by row, start and period; values are equal where words are."""
    lengths = np.diff(first)
    far = np.zeros(len(values), np.int64)  # for every word the furthest end of a run found that holds it
    found: dict[tuple[int, int, int], int] = {}
    for row, period in _period_blocks(lengths, exponent):
        points = (lengths[row] - 1) // period
        pair = np.repeat(np.arange(len(row)), points)
        step = period[pair]
        at = first[row][pair] + ranges(np.zeros(len(row), np.int64), points) * step
        hit = np.flatnonzero(values[at] == values[at + step])
        triple = hit[:-2][(hit[2:] == hit[:-2] + 2) & (pair[hit[2:]] == pair[hit[:-2]])] if len(hit) > 2 else hit[:0]
        triple = triple[far[at[triple]] <= at[triple] + 3 * step[triple]]
        if not len(triple):
            continue
        new = np.concatenate([[True], (np.diff(triple) > 1) | (np.diff(pair[triple]) > 0)])
        begins, ends = triple[new], triple[np.concatenate([new[1:], [True]])]
        for place, last, p, r in zip(at[begins].tolist(), at[ends].tolist(), step[begins].tolist(), row[pair[begins]].tolist(), strict=True):
            lo, hi = int(first[r]), int(first[r + 1])
            while place <= last:
                known = int(far[place])
                if known > place + 3 * p:
                    place += -(-(known - 3 * p - place) // p) * p
                    continue
                right = _differs(values, place, 1, hi - p, p)
                start, end = _differs(values, place - 1, -1, lo - 1, p) + 1, right + p
                if end - start >= max(least, exponent * p):
                    found.setdefault((r, start - lo, end - start), p)  # a multiple of the period may come back by a chance hit past the run's end
                    far[start:end] = np.maximum(far[start:end], end)
                place += ((right - place) // p + 1) * p
    runs = np.array([(*stretch, p) for stretch, p in found.items()], np.int64).reshape(-1, 4)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _true_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: np.ndarray) -> bool:
    """Whether the words of the runs, and not only their hashes, are those one period on."""
    for r, start, length, period in runs.tolist():
        for a in range(first[r] + start, first[r] + start + length - period, PROBES >> 4):
            b = min(a + (PROBES >> 4), first[r] + start + length - period)
            here, there = ends[a:b] - starts[a:b], ends[a + period : b + period] - starts[a + period : b + period]
            if (here != there).any() or (data[ranges(starts[a:b], here)] != data[ranges(starts[a + period : b + period], there)]).any():
                return False
    return True


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space."""
    parts = []
    for a in range(0, len(starts), PROBES >> 4):
        begin, size = starts[a : a + (PROBES >> 4)], ends[a : a + (PROBES >> 4)] - starts[a : a + (PROBES >> 4)] + 1
        at = np.cumsum(size) - 1
        source = ranges(begin, size)
        source[at] = 0
        text = data[source]
        text[at] = 32
        parts.append(text.tobytes())
    return b"".join(parts)[:-1]


def _found(texts: pa.Array, exponent: int, least: int) -> pa.Array:
    """n_words, runs and the collapsed text of each text."""
    counts, collapsed, found, upto = [], [], [], [0]
    for _, _, data, offsets in text_chunks(texts):
        values, starts, ends, first = word_hashes(data, offsets)
        runs = word_runs(values, first, exponent, least)
        if not _true_words(data, starts, ends, first, runs):
            text = data.tobytes()
            values = pd.factorize(np.array([text[a:b] for a, b in zip(starts, ends, strict=True)], object))[0]
            runs = word_runs(values, first, exponent, least)
        edge = np.zeros(len(values) + 1, np.int64)
        begin = first[runs[:, 0]] + runs[:, 1]
        np.add.at(edge, begin + runs[:, 3], 1)
        np.add.at(edge, begin + runs[:, 2], -1)
        kept = np.cumsum(edge[:-1]) == 0
        for r in range(len(first) - 1):
            keep = np.flatnonzero(kept[first[r] : first[r + 1]]) + first[r]
            collapsed.append(_joined(data, starts[keep], ends[keep]))
        counts.append(np.diff(first))
        found.append(runs)
        upto.extend((upto[-1] + np.searchsorted(runs[:, 0], np.arange(1, len(first)))).tolist())
    at = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(at[:, i])) for i in (1, 2, 3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), fields)
    n_words = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64))
    return pa.StructArray.from_arrays([n_words, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, text: str = "text", out: str = "found", exponent: int = 4, least: int = 6) -> DataFrame:
    """`docs` with struct<n_words, runs, collapsed> of each text: the runs of at least `exponent` periods and `least` words by start
    and period, and the text's words, joined by one space, without what any run has after its first period."""
    if exponent < 4:
        raise ValueError("three neighbouring grid points lie in a run of four periods or more")

    @F.arrow_udf("struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def found(texts: pa.Array) -> pa.Array:
        return _found(texts, exponent, least)

    return docs.withColumn(out, found(F.col(text)))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))


def with_planted_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of documents whose h = crc32(doc_id) is divisible by 10, the words from a = g % n on repeat the p words there,
    g = h / 10, p = 1 + (n - a) / (3 + g % 8); the others as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    cut = docs.select("doc_id", "text", h.alias("_h")).select("doc_id", "text", F.floor(F.col("_h") / 10).alias("_g"), F.when(F.col("_h") % 10 == 0, words).alias("_w"))
    sized = cut.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    looped = sized.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    loop = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(loop, F.lit(1), rest)), " ")
    return looped.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of each document with planted loops, and digests of all runs and of the collapsed text."""
    found = with_runs(with_planted_loops(docs)).select("doc_id", F.col("found.runs").alias("runs"), F.col("found.collapsed").alias("collapsed"))
    best = found.withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
