"""Long repeats, found near sparse anchors.

A window of `window` symbols (bytes, or words) is owned by the k-gram in it whose hash is least (of equal ones the first).
Equal windows have equal owners at equal places, so all occurrences of a repeated window meet where the windows are grouped by
their owner's k-gram, which is a prefix of a window's rest. Only about 2 / (window - k + 2) of all places own windows, and only
k-grams that are met at another place are looked at further: what they own is shipped with its context, as far as the last
window reaches. Equal contexts are one with several owners, and are put together before they are shuffled.

A text that several rows share is one content (two 64-bit hashes), so exact copies are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loomwork.llm.shared import byte_values, checkpointed, column_of, gram_hashes, mix, ranges, span_hashes, text_chunks, word_bounds, word_hashes
from loomwork.storage import stored

#: Contexts of one k-gram that one task holds at most (about 40 MB); the windows of more frequent ones are grouped one by one.
TASK_CONTEXTS = 65_536
#: At most so many k-grams (8 MB) are told to all tasks as very frequent; if there are more, they have to be more frequent.
HOT_GRAMS = 1 << 20
#: Symbols' bytes that a solver takes at once, where the groups allow it.
BATCH_BYTES = 1_500_000


@dataclass(frozen=True)
class Scheme:
    """words: symbols are words (64-bit hashes), else bytes."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of a chunk, their values for hashing, and the first of each row (one more at the end)."""
        if self.words:
            hashes, _, _, first = word_hashes(data, offsets)
            return hashes, hashes, first
        return data, byte_values(data), offsets

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that contexts of a chunk are cut from, and where each symbol begins in them (one more at the end): words are followed by one space each."""
        if not self.words:
            return data, np.arange(len(data) + 1)
        starts, ends, _ = word_bounds(data, offsets)
        lengths = ends - starts + 1
        upto = np.cumsum(lengths)
        at = ranges(starts, lengths)
        at[upto - 1] = 0
        joined = data[at]
        joined[upto - 1] = 32
        return joined, np.concatenate([[0], upto])

    def read(self, contexts: list[bytes]) -> list[np.ndarray]:
        """The symbols of contexts."""
        if not self.words:
            return [np.frombuffer(c, np.uint8) for c in contexts]
        ends = np.cumsum([0, *map(len, contexts)])
        hashes, _, _, first = word_hashes(np.frombuffer(b"".join(contexts), np.uint8), ends)
        return np.split(hashes, first[1:-1])


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, order, h1, h2, text): order is doc_id, or the largest number for a null one; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(2**63 - 1)).alias("order"), text.alias("text"))
    return docs.select("doc_id", "order", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"), "text")


def owners(values: np.ndarray, first: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every owner of windows: its row, its k-gram's hash, its first window and how many windows it owns."""
    rows = np.flatnonzero(np.diff(first) >= scheme.window)
    if not len(rows):
        return rows, np.zeros(0, np.uint64), rows, rows
    grams = gram_hashes(values, scheme.gram)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span, low = scheme.window - scheme.gram + 1, 1, key
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    n = len(key) - width + 1
    low = np.minimum(low[:n], low[width - span : width - span + n])
    counts = first[rows + 1] - first[rows] - scheme.window + 1
    starts = ranges(first[rows], counts)
    owner = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(rows, counts)
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])]))
    return row[new], grams[owner[new]], starts[new], np.diff(np.concatenate([new, [len(owner)]]))


def _anchor_rows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """(h1, h2, gram, first, n) of every owner in every row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (column_of(batch, c).to_numpy() for c in ("h1", "h2"))
            for lo, _, data, offsets in text_chunks(column_of(batch, "text")):
                _, values, first = scheme.symbols(data, offsets)
                row, gram, start, n = owners(values, first, scheme)
                yield pa.RecordBatch.from_arrays([pa.array(h1[lo + row]), pa.array(h2[lo + row]), pa.array(gram.view(np.int64)), pa.array((start - first[row]).astype(np.int64)), pa.array(n.astype(np.int32))], ["h1", "h2", "gram", "first", "n"])

    return docs.select("h1", "h2", "text").mapInArrow(found, "h1 long, h2 long, gram long, first long, n int")


def _contexts(texts: DataFrame, scheme: Scheme) -> DataFrame:
    """(gram, owners, symbols): equal contexts of a batch are one row, as bytes of text, which pack better than hashes; owners are int64
    (h1, h2, order, first), one after the other."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, order = (column_of(batch, c).to_numpy() for c in ("h1", "h2", "order"))
            lists = column_of(batch, "anchors")
            ends, flat = lists.offsets.to_numpy(), lists.values
            gram, start, n = (flat.field(c).to_numpy() for c in ("gram", "first", "n"))
            met: dict[tuple[int, bytes], list[int]] = {}
            for lo, hi, data, offsets in text_chunks(column_of(batch, "text")):
                _, _, first = scheme.symbols(data, offsets)
                plain, at = scheme.plain(data, offsets)
                for r in range(lo, hi):
                    for a in range(ends[r], ends[r + 1]):
                        begin = first[r - lo] + start[a]
                        key = int(gram[a]), plain[at[begin] : at[begin + n[a] - 1 + scheme.window]].tobytes()
                        met.setdefault(key, []).extend((h1[r], h2[r], order[r], start[a]))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in met], pa.int64()), pa.array([np.array(v, np.int64).tobytes() for v in met.values()], pa.binary()), pa.array([k[1] for k in met], pa.binary())], ["gram", "owners", "symbols"])

    return texts.mapInArrow(cut, "gram long, owners binary, symbols binary")


#: From contexts (distinct, each with its number of owners' places and least order) to, for each window of each context, a mark:
#: how many places have it (capped at 2) or the least order of a document that has it.
Solver = Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]


def _solved(groups: DataFrame, scheme: Scheme, solve: Solver, across: bool) -> DataFrame:
    """(h1, h2, start, n): runs of windows to remove, of every owner of every context."""
    names = ["h1", "h2", "start", "n"]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Distinct contexts with their owners, cut between k-grams (rows come sorted by them)."""
        met: dict[tuple[int, bytes], list[bytes]] = {}
        size, last = 0, None
        for batch in batches:
            for gram, own, symbols in zip(*(column_of(batch, c).to_pylist() for c in ("gram", "owners", "symbols")), strict=True):
                if gram != last and size > BATCH_BYTES:
                    yield met
                    met, size = {}, 0
                last = gram
                have = met.setdefault((gram, symbols), [])
                size += 0 if have else len(symbols)
                have.append(own)
        if met:
            yield met

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in batches_of(batches):
            own = [np.unique(np.frombuffer(b"".join(x), np.int64).reshape(-1, 4), axis=0) for x in met.values()]
            places = np.array([len(x) for x in own])
            least = np.array([x[:, 2].min() for x in own])
            marks = solve(scheme.read([s for _, s in met]), places, least)
            out = []
            for who, mark in zip(own, marks, strict=True):
                if across:  # the document that has a window first keeps it
                    bound = np.unique(np.concatenate([[0], np.flatnonzero(mark[1:] != mark[:-1]) + 1, [len(mark)]]))
                    for a, b in zip(bound[:-1], bound[1:], strict=True):
                        late = who[who[:, 2] > mark[a]]
                        out.append(np.column_stack([late[:, :2], late[:, 3] + a, np.full(len(late), b - a)]))
                else:
                    edge = np.diff(np.concatenate([[0], (mark > 1).astype(np.int8), [0]]))
                    for a, b in zip(np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True):
                        out.append(np.column_stack([who[:, :2], who[:, 3] + a, np.full(len(who), b - a)]))
            got = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, i])) for i in range(4)], names)

    return groups.repartition("gram").sortWithinPartitions("gram").mapInArrow(runs, "h1 long, h2 long, start long, n long")


def _single_windows(docs: DataFrame, scheme: Scheme, across: bool, hot: np.ndarray, same: DataFrame) -> DataFrame:
    """The same for very frequent k-grams (`hot`, sorted): their windows are grouped one by one, by two hashes, with partial aggregation.

    Texts are read again rather than shuffled, so copies take part here; they change neither which texts have a window nor where.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(hot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, order = (column_of(batch, c).to_numpy() for c in ("h1", "h2", "order"))
            for lo, _, data, offsets in text_chunks(column_of(batch, "text")):
                _, values, first = scheme.symbols(data, offsets)
                row, gram, begin, n = owners(values, first, scheme)
                of_hot = np.isin(gram, shipped.value)
                row = np.repeat(row[of_hot], n[of_hot])
                begin = ranges(begin[of_hot], n[of_hot])
                at, row = begin - first[row], row + lo
                w1 = span_hashes(values, begin, begin + scheme.window)
                w2 = span_hashes(mix(values + np.uint64(12345)), begin, begin + scheme.window)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(h1[row]), pa.array(h2[row]), pa.array(order[row]), pa.array(at)], ["w1", "w2", "h1", "h2", "order", "start"])

    windows = docs.select("h1", "h2", "order", "text").mapInArrow(cut, "w1 long, w2 long, h1 long, h2 long, order long, start long")
    facts = windows.groupBy("w1", "w2").agg(F.min("order").alias("low"), F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("start").alias("c"), F.max("start").alias("d"))
    again = stored(facts.where("a <> b or c <> d").select("w1", "w2", "low"))  # stored for the same reason as the repeated k-grams
    hit = windows.join(again, ["w1", "w2"]).select("h1", "h2", "start", "low").distinct()
    hit = hit.join(same, ["h1", "h2"]).where("rep > low") if across else hit
    return hit.select("h1", "h2", "start", F.lit(1).cast("long").alias("n"))


def repeated_runs(docs: DataFrame, scheme: Scheme, solve: Solver, across: bool, task_contexts: int = TASK_CONTEXTS) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, rep, copies) of every content, and (h1, h2, runs array<struct<start, n>>) of the windows to remove from it.

    across: windows that also start in a document of a smaller order, else windows that also start at another place.
    Whatever grows with the input is joined by sorting, at every size, so that the plan which small tables are measured with is
    the one of large tables.
    """
    anchors = stored(_anchor_rows(docs, scheme))
    same = docs.groupBy("h1", "h2").agg(F.min("order").alias("rep"), F.count("*").alias("copies"))
    facts = anchors.groupBy("gram").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("first").alias("c"), F.max("first").alias("d"), F.count("*").alias("often"))
    # a table of its own, so that Spark may split what a frequent k-gram has on the other side of the join
    again = stored(facts.where("a <> b" if across else "a <> b or c <> d").select("gram", "often"))
    hot = again.where(F.col("often") > task_contexts).select("gram")
    while hot.count() > HOT_GRAMS:
        task_contexts *= 2
        hot = again.where(F.col("often") > task_contexts).select("gram")
    cold = again.where(F.col("often") <= task_contexts).select("gram")
    lists = anchors.join(cold.hint("merge"), "gram").groupBy("h1", "h2").agg(F.collect_set(F.struct("gram", "first", "n")).alias("anchors"))
    near = checkpointed(lists.join(same.withColumnRenamed("rep", "order").drop("copies").hint("merge"), ["h1", "h2"]))
    texts = docs.select("h1", "h2", "order", "text").join(near.hint("merge"), ["h1", "h2", "order"])
    runs = _solved(_contexts(texts.select("h1", "h2", "order", "anchors", "text"), scheme), scheme, solve, across)
    grams = np.sort(hot.toArrow()["gram"].to_numpy().view(np.uint64))
    if len(grams):
        runs = runs.unionByName(_single_windows(docs, scheme, across, grams, same))
    return same, runs.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "n")).alias("runs"))


def covered(runs: list[Row | dict] | None, window: int, length: int) -> np.ndarray:
    """Which of `length` symbols the windows of the runs cover."""
    edge = np.zeros(length + 1, np.int64)
    if runs:
        start = np.array([r["start"] for r in runs], np.int64)
        n = np.array([r["n"] for r in runs], np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + n - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
