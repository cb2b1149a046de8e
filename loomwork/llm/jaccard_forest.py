"""N-gram Jaccard join: a MinHash LSH forest finds candidates, and every candidate pair is verified exactly.

Texts become sets of five-word shingles (a text of one to four words has one shingle, all its words). Equal texts are one
content, with a number of copies. A forest has `trees` prefix tries over MinHash signatures of `longest` values each. Two
sets of similarity s share a prefix of length k in one tree with probability s**k, so matched prefixes are shortened from
`longest` until 1 - (1 - threshold**k)**trees reaches the target recall (0.9999: k = 6 of 8 with 32 trees); nodes of shorter
prefixes contain those of longer ones, so only the nodes of the last length have to be formed. Contents
of a node are linked if enough of all their MinHash values agree, so that a chain of texts that are alike to about a half doesn't
become one block. A node's contents are held against its smallest one first, which takes as many rows as it has contents,
whatever its size; only what is left is compared further. Linked contents form a block, and all pairs of a block are compared exactly: in one task if it is small, else in pairs of chunks of bounded size, where products of
0/1 matrices count common shingles. Only sums and spanning links leave a task, never the pairs.

Defined cases: a null text counts as empty; a text without words is similar to nothing, not even to its copies, and is a class of
its own; a very long text is read in one step and may be a chunk of its own, larger than others; a null doc_id stays null and is never a class id unless all of its class are null; repeated rows are copies of each
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import checkpointed, column_of, gram_hashes, linked_components, mix, ranges, set_aside, span_hashes, text_chunks, word_hashes
from loomwork.storage import stored

SHINGLE_WORDS = 5
#: A chunk of a block has about so many contents and words at most.
CHUNK_CONTENTS, CHUNK_WORDS = 1024, 1 << 21
#: Shared shingles that one product of matrices counts.
PRODUCT_WIDTH = 512


def forest_depth(trees: int, longest: int, threshold: float, recall: float) -> int:
    """The longest prefix at which a pair of similarity `threshold` is found with probability `recall`."""
    k = longest
    while k > 1 and 1 - (1 - threshold**k) ** trees < recall:
        k -= 1
    return k


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, the first of each row (one more at the end), and the rows' words."""
    words, _, _, first = word_hashes(data, offsets)
    counts = np.diff(first)
    sizes = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    at = ranges(first[:-1], sizes)
    grams = gram_hashes(words, SHINGLE_WORDS)
    short = np.repeat(counts < SHINGLE_WORDS, sizes)
    out = np.zeros(len(at), np.uint64)
    out[~short] = grams[at[~short]]
    rows = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    out[short] = span_hashes(words, first[rows], first[rows + 1])
    return out, np.concatenate([[0], np.cumsum(sizes)]), counts


def _forest_keys(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """(doc_id, h1, h2, words, keys, signature): the node of every tree that a text belongs to (none for a text without words), and one byte of every MinHash value."""
    draw = np.random.default_rng(7)
    factors = draw.integers(1, 1 << 62, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 1 << 63, trees * depth, dtype=np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, values, signatures = [], [np.zeros(1, np.int64)], [], []
            for _, _, data, offsets in text_chunks(column_of(batch, "text")):
                shingles, first, counts = _shingles(data, offsets)
                rows = np.flatnonzero(np.diff(first))
                node = np.zeros((len(rows), trees), np.uint64)
                signature = np.zeros((len(counts), trees * depth), np.uint8)
                work = np.empty_like(shingles)
                for i, (factor, shift) in enumerate(zip(factors, shifts, strict=True)):
                    if len(rows):
                        np.multiply(shingles, factor, out=work)
                        np.add(work, shift, out=work)
                        low = np.minimum.reduceat(work, first[rows])
                        signature[rows, i] = mix(low.copy()).astype(np.uint8)
                        node[:, i // depth] = mix(node[:, i // depth] * np.uint64(31) + low + np.uint64(i // depth))
                words.append(counts)
                sizes.append(np.where(np.diff(first) > 0, trees, 0))
                values.append(node.ravel())
                signatures += [x.tobytes() for x in signature]
            if words:
                ends = np.cumsum(np.concatenate(sizes)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("doc_id", "h1", "h2")), pa.array(np.concatenate(words)), lists, pa.array(signatures, pa.binary())], ["doc_id", "h1", "h2", "words", "keys", "signature"])

    return docs.mapInArrow(keys, "doc_id long, h1 long, h2 long, words long, keys array<long>, signature binary")


def least_agreement(values: int, threshold: float) -> int:
    """So many of `values` MinHash values of a pair at the threshold agree, but for one pair in some millions (five standard deviations)."""
    return floor(values * threshold - 5 * sqrt(values * threshold * (1 - threshold)))


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _least_labels(linked: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For rows 0 to n-1 the least row that each can reach by links between `left` and `right`."""
    label = np.arange(n)
    while True:
        low_left = np.minimum(label[left], np.where(linked, label[right][None], n).min(1, initial=n))
        low_right = np.minimum(label[right], np.where(linked, low_left[:, None], n).min(0, initial=n))
        new = label.copy()
        np.minimum.at(new, left, low_left)
        np.minimum.at(new, right, low_right)
        if (new == label).all():
            return label
        label = new


def _agreeing(least: int):
    """Spanning links (a, b), between components, of the signatures that agree between two chunks of a node."""

    def links(table: pa.Table) -> pa.Table:
        component, chunk = table["c"].to_numpy(), table["chunk"].to_numpy()
        signature = _signatures(table["signature"])
        left, right = np.flatnonzero(chunk == table["p"][0].as_py()), np.flatnonzero(chunk == table["q"][0].as_py())
        other = signature[right]
        linked = np.zeros((len(left), len(right)), bool)
        for i, x in enumerate(left):
            linked[i] = (other == signature[x]).sum(1) >= least
        least_of = component[_least_labels(linked, left, right, len(component))]
        some = least_of != component
        return pa.table({"a": component[some], "b": least_of[some]})

    return links


def _likely(contents: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """(cid, c): components of contents by links to the smallest one of a node, and edges (a, b) between the components, if there may be any.

    Each content of a node is held against the node's smallest one. Those that agree are linked, here or through others, so only
    nodes that still hold several components are looked at further: their other contents are held against all of the node,
    in pairs of chunks. Neither a pair within the smallest one's component nor an unlikely pair leads to an edge.
    """
    signatures = contents.select("cid", "signature")
    nodes = contents.select("cid", F.explode("keys").alias("key"))
    stars = nodes.groupBy("key").agg(F.min("cid").alias("b"), F.count("*").alias("n")).where("n > 1")
    # nodes of two contents are done with their one pair, so their keys aren't kept
    shared = stored(nodes.join(stars, "key").select(F.when(F.col("n") > 2, F.col("key")).alias("key"), "cid", "b"))
    # no content has more pairs than there are trees, and the join by `a` needs no other partitions
    pairs = shared.where("cid <> b").select(F.col("cid").alias("a"), "b").repartition("a").distinct()
    pairs = pairs.join(signatures.toDF("a", "s"), "a").join(signatures.toDF("b", "t"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_signatures(column_of(batch, "s")) == _signatures(column_of(batch, "t"))).sum(1) >= least
                yield batch.select(["a", "b"]).filter(pa.array(same))

    first = checkpointed(linked_components(pairs.mapInArrow(near, "a long, b long")).toDF("cid", "c"))
    placed = shared.where("key is not null").join(first, "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    mixed = placed.groupBy("key").agg(F.max(F.when(F.col("cid") == F.col("b"), F.col("c"))).alias("d"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    placed = checkpointed(placed.join(mixed, "key").select("key", "cid", "c", (F.col("c") != F.col("d")).cast("int").alias("rest")))
    if placed.isEmpty():
        return first, None
    sizes = placed.groupBy("key").agg(F.sum("rest").alias("r"), F.count("*").alias("n"))
    sizes = sizes.select("key", F.ceil((F.col("n") - F.col("r")) / CHUNK_CONTENTS).cast("int").alias("before"), F.ceil(F.col("r") / CHUNK_CONTENTS).cast("int").alias("after"))
    near_chunk, rest_chunk = F.pmod(F.xxhash64("cid"), F.col("before")).cast("int"), F.pmod(F.xxhash64("cid"), F.col("after")).cast("int") + F.col("before")
    placed = placed.join(sizes, "key").withColumn("chunk", F.when(F.col("rest") == 1, rest_chunk).otherwise(near_chunk)).join(signatures, "cid")
    partners = F.sequence(F.when(F.col("rest") == 1, F.lit(0)).otherwise(F.col("before")), F.col("before") + F.col("after") - 1)
    met = placed.withColumn("o", F.explode(partners)).select("key", F.least("o", "chunk").alias("p"), F.greatest("o", "chunk").alias("q"), "c", "chunk", "signature")
    return first, met.groupBy("key", "p", "q").applyInArrow(_agreeing(least), "a long, b long")


def _likely_links(contents: DataFrame, least: int) -> DataFrame:
    """Edges (a, b) that span the contents which share a node and whose signatures agree in `least` values."""
    first, more = _likely(contents, least)
    links = first.select(F.col("cid").alias("a"), F.col("c").alias("b"))
    return links if more is None else links.unionByName(more.distinct())


def _likely_blocks(contents: DataFrame, least: int) -> DataFrame:
    """(cid, block) of the contents that have any likely link; linked ones share a block."""
    first, more = _likely(contents, least)
    if more is None:
        return first.withColumnRenamed("c", "block")
    joined = checkpointed(linked_components(more).toDF("c", "block"))
    alone = joined.withColumnRenamed("c", "cid").join(first, "cid", "left_anti")
    return checkpointed(first.join(joined, "c", "left").select("cid", F.coalesce("block", "c").alias("block")).unionByName(alone))


def _verify(threshold: Fraction):
    """Exact links inside one chunk or between two: (cid, root, links, whole) for contents that have any; whole: the chunk is all of its block, so that roots are final."""

    def links(table: pa.Table) -> pa.Table:
        cid = table["cid"].to_numpy()
        _, once = np.unique(cid, return_index=True)  # repeated rows
        table = table.take(pa.array(once))
        cid, chunk, copies = (table[c].to_numpy() for c in ("cid", "chunk", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        left, right = np.flatnonzero(chunk == p), np.flatnonzero(chunk == q)
        if not len(left) or not len(right) or len(cid) < 2:
            return pa.table({c: pa.array([], kind) for c, kind in (("cid", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("whole", pa.bool_()))})
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = often[at] > 1
        at, row = np.unique(at[shared], return_inverse=True)[1], row[shared]
        width = int(at.max()) + 1 if len(at) else 0
        common = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row[order]
        for begin in range(0, width, PRODUCT_WIDTH):
            part = slice(*np.searchsorted(at, [begin, begin + PRODUCT_WIDTH]))
            has = np.zeros((len(sets), min(PRODUCT_WIDTH, width - begin)), np.float32)
            has[row[part], at[part] - begin] = 1
            common += has[left] @ has[right].T
        common = common.astype(np.int64)
        union = size[left][:, None] + size[right][None] - common
        linked = (common > 0) & (common * threshold.denominator >= union * threshold.numerator)
        linked &= cid[left][:, None] != cid[right][None]
        total = np.zeros(len(cid), np.int64)
        total[left] += linked @ copies[right]
        if p != q:
            total[right] += linked.T @ copies[left]
        # spanning links: every content takes the least label that it can reach here
        label = _least_labels(linked, left, right, len(cid))
        some = total > 0
        return pa.table({"cid": cid[some], "root": cid[label[some]], "links": total[some], "whole": np.full(some.sum(), table["chunks"][0].as_py() == 1)})

    return links


def _content(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a content."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _placed(docs: DataFrame, threshold: float, trees: int = 32, longest: int = 8, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, words) of every document, and (h1, h2, rep, component, copies, links) of every content with words."""
    text = F.coalesce("text", F.lit(""))
    h1, h2 = _content(F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    depth = forest_depth(trees, longest, threshold, recall)
    ids = checkpointed(_forest_keys(docs, trees, depth))
    contents = ids.where("words > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("words").alias("words"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    # the checkpoint's files fix the order of rows, so this number names a content for good
    contents = checkpointed(contents).withColumn("cid", F.monotonically_increasing_id())

    blocks = _likely_blocks(contents, least_agreement(trees * depth, threshold))
    members = contents.select("cid", "h1", "h2", "rep", "copies", "words").join(blocks, "cid")
    sizes = members.groupBy("block").agg(F.greatest(F.ceil(F.sum("words") / CHUNK_WORDS), F.ceil(F.count("*") / CHUNK_CONTENTS)).cast("int").alias("chunks"))
    members = members.join(sizes, "block").withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).drop("words")
    texts = docs.join(members, ["h1", "h2"]).where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("block", "cid", "copies", "chunk", "chunks", "text")

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for lo, hi, data, offsets in text_chunks(column_of(batch, "text")):
                shingles, first, _ = _shingles(data, offsets)
                sets += [np.unique(shingles[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            names = ["block", "cid", "copies", "chunk", "chunks"]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    sets = texts.mapInArrow(shingle_sets, "block long, cid long, copies long, chunk int, chunks int, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least(o, "chunk").alias("p"), F.greatest(o, "chunk").alias("q")))
    met = sets.withColumn("pair", F.explode(pairs)).select("block", "cid", "copies", "chunk", "chunks", F.col("pair.p").alias("p"), F.col("pair.q").alias("q"), "shingles")
    found = checkpointed(met.groupBy("block", "p", "q").applyInArrow(_verify(Fraction(str(threshold))), "cid long, root long, links long, whole boolean"))

    classes = found.where("whole").select(F.col("cid").alias("node"), F.col("root").alias("component"))
    parts = found.where("not whole").select(F.col("cid").alias("a"), F.col("root").alias("b"))
    if not parts.isEmpty():
        classes = classes.unionByName(linked_components(parts))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = contents.select("cid", "h1", "h2", "rep", "copies").join(links, "cid", "left").join(classes.withColumnRenamed("node", "cid"), "cid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cid"))
    return ids, placed


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, trees: int = 32, longest: int = 8, recall: float = 0.9999) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Documents whose texts are linked, directly or through others, are a class; class_id is its smallest doc_id. n_links counts
    the other documents (copies too) of similarity `threshold` or more.
    """
    ids, placed = _placed(docs, threshold, trees, longest, recall)
    low = placed.groupBy("component").agg(F.min("rep").alias("class_id"))
    placed = placed.join(low, "component").select("h1", "h2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = ids.select("doc_id", "h1", "h2", "words").join(placed, ["h1", "h2"], "left")
    return out.select("doc_id", F.when(F.col("words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`docs` with one document of each class: the one of the smallest (doc_id, content), where rows without doc_id come last, once.

    Keepers are found by doc_id and content, so that texts which share a doc_id, or have none, don't stand for each other.
    Texts without words are classes of their own and all stay.
    """
    docs, restore = set_aside(docs)
    ids, placed = _placed(docs, threshold)
    least = placed.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h1", "h2")).alias("k"))
    blank = ids.where("words = 0").select("doc_id", "h1", "h2", F.lit(True).alias("_blank")).distinct()
    keepers = least.select(F.col("k.rep").alias("doc_id"), "k.h1", "k.h2", F.lit(False).alias("_blank")).unionByName(blank).toDF("_kept", "_k1", "_k2", "_blank")
    docs = docs.withColumns({f"_h{i + 1}": h for i, h in enumerate(_content(F.coalesce("text", F.lit(""))))})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    kept = docs.join(keepers, same)
    again = ids.where("words > 0").groupBy("doc_id", "h1", "h2").count().where("count > 1").drop("count").toDF("doc_id", "_h1", "_h2")
    if again.join(keepers, same, "left_semi").limit(1).count():
        kept = kept.where("_blank").unionByName(kept.where("not _blank").dropDuplicates(["doc_id", "_h1", "_h2"]))
    return restore(kept)
