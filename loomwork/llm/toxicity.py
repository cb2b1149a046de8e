"""Toxicity by class-conditional Kneser-Ney models of words after words.

C_c(v, w) is the number of documents of class c (ordinary, toxic) in which the lower-cased word w follows v (or begins the
document); documents are counted, so that one which repeats itself doesn't outweigh others. A pair that fewer than `MIN_PAIR`
documents of both classes together hold is left to the backoff; every other pair and every word is in the model:

    P_c(w | v) = (1 - b(v)) X_c(w | v) + b(v) P_c(w)      X_c(w | v) = (C_c(v, w) + S q(w | v)) / (C_c(v) + S)
    P_c(w)     = (max(N_c(w) - d_c, 0) + (d_c T_c + M) P(w)) / (N_c + M)

b(v) is the mass that Kneser-Ney's discount and the rare pairs free in the counts of both classes, and q the discounted shares of
v's pairs in them: backoff counts which the classes share. N_c(w) is the continuation count, the number of different words
before w in class c; N_c and T_c are its total and the number of words that have one; P(w) is the continuation share in both
classes, plus one. M is the smaller N_c, so the larger class doesn't win by size. A pair that isn't in the model has P_c(w).

With e = log P_toxic - log P_ordinary of each word, the evidence of a document is the mean of e ** 3 over its words: the
length-normalised difference of both log-likelihoods, in which telling words outweigh the many nearly neutral ones. A logistic
curve makes it a score. Labelled rows are dealt out by crc32(doc_id) mod 5: 0 is held out, 2 to 4 are counted, and the curve is
fitted over a histogram of the evidence of 1, whose rows weren't counted. All of them take part; nothing is sampled.

The HOT entries with the highest counts reach the tasks as a table (67 MB at most). If there are more, the rest stay a stored
table, with which the pairs and words of texts that aren't hot are joined, counted once a text; so no entry is lost.

Defined cases: null or empty text has no words and evidence 0; a null doc_id is held out; labels with null fields are
left out; a document labelled twice counts as toxic if either label says so; repeated rows count as they stand; if the counted
rows lack one class (or there are none), every score is the smoothed share of toxic ones, (toxic + 0.5) / (rows + 2). A very
long text is one chunk of its own: a task holds about 60 bytes for each of its words. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.shared import byte_values, column_of, mix, span_hashes, text_chunks
from loomwork.storage import stored

#: Pairs that fewer documents hold back off to their second word.
MIN_PAIR = 3
#: S: so many shared counts are mixed into the counts after each word.
STRENGTH = 50.0
#: At most so many entries are broadcast; the others are joined.
HOT = 1 << 22
#: The curve is fitted over so many bins of evidence between -REACH and REACH.
BINS, REACH = 1 << 16, 8
#: A label table of at most this many rows (under 40 MB) is broadcast to the documents; a larger one is joined by a shuffle.
BROADCAST_LABELS = 1 << 21
#: What stands for the word before the first one.
START = np.uint64(0x5354415254)
#: Distinct pairs that a counting task holds before it hands them on.
HELD_PAIRS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[128:] = _IN_WORD[97:123] = _IN_WORD[48:58] = True
_IN_WORD[39] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word of a chunk: the one before it in its row, its own hash (both even), and its row."""
    n = len(data)
    data = _LOWER[data]
    edge = np.zeros(n + 2, bool)
    edge[1:-1] = _IN_WORD[data]
    begins = edge[1:-1] & ~edge[:-2]
    ends = edge[1:-1] & ~edge[2:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = edge[1:-1][cuts]
    ends[cuts - 1] = edge[1:-1][cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    w = span_hashes(byte_values(data), starts, stops) & ~np.uint64(1)
    row = np.searchsorted(offsets, starts, "right") - 1
    v = np.full(len(w), START)
    v[1:] = np.where(row[1:] == row[:-1], w[:-1], START)
    return v, w, row


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key of each pair, which is odd; those of words are even."""
    return mix(v * np.uint64(0x9E3779B97F4A7C15) + w) | np.uint64(1)


@dataclass
class ToxicityModel:
    keys: np.ndarray  # int64: the hot words and pairs, sorted
    e: np.ndarray  # float64: log P_toxic - log P_ordinary of each
    unknown: float  # of a word that was never counted
    rest: DataFrame | None  # (key, e) of all others, if there are any
    slope: float
    intercept: float


def _looked_up(keys: np.ndarray, e: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """e of the wanted keys, NaN where they aren't hot."""
    if not len(keys) or not len(wanted):
        return np.full(len(wanted), np.nan)
    once, at = np.unique(wanted.view(np.int64), return_inverse=True)
    place = np.minimum(np.searchsorted(keys, once), len(keys) - 1)
    return np.where(keys[place] == once, e[place], np.nan)[at]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents whose labels are never learned."""
    return _fold(doc_id) == 0


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, text, toxic) of the labelled rows that aren't held out; fold 1 is for the curve."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"), F.first(_fold(F.col("doc_id"))).alias("_fold"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    docs = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text"))
    return docs.join(known, "_id").select("_fold", "text", "_toxic")


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(v, w, o, t): in how many ordinary and toxic documents w follows v; and one row (null, null, documents of either class)."""
    names = ["v", "w", "o", "t"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, np.zeros(2, np.int64)

        def summed() -> list[np.ndarray]:
            v, w, o, t = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((v, w))  # equal words side by side pack well
            v, w, o, t = v[order], w[order], o[order], t[order]
            new = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
            return [v[new], w[new], np.add.reduceat(o, new), np.add.reduceat(t, new)]

        def batch_of(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)

        for batch in batches:
            toxic = (column_of(batch, "_toxic").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            seen += np.bincount(toxic, minlength=2)[:2]
            for lo, _, data, offsets in text_chunks(column_of(batch, "text")):
                v, w, row = _words(data, offsets)
                if not len(w):
                    continue
                once = np.unique(mix(_pair_keys(v, w) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]
                label = toxic[lo:][row[once]]
                parts.append([v[once], w[once], 1 - label, label])
                size += len(once)
                if size > 2 * HELD_PAIRS:
                    parts = [summed()]
                    size = len(parts[0][0])
                    if size > HELD_PAIRS:
                        yield batch_of(parts[0])
                        parts, size = [], 0
        if parts:
            yield batch_of(summed())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array(seen[:1]), pa.array(seen[1:])], names)

    return rows.mapInArrow(count, "v long, w long, o long, t long").groupBy("v", "w").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))


def _facts(pairs: DataFrame) -> DataFrame:
    """One row for each pair in the model, (v, w, o, t), and for each word, (v, null): its continuation counts o and t in both
    classes, `pool` counts after it, of which those of pairs in the model are c0 and c1 (`kept` pairs), and ones and twos of
    pairs that 1 and 2 documents hold. The row without a word has the documents of either class."""
    pool, zero = F.col("o") + F.col("t"), F.lit(0).cast("long")
    kept = pool >= MIN_PAIR
    none = F.lit(None).cast("long")

    def number(condition: Column) -> Column:
        return F.when(condition, F.lit(1)).otherwise(0).cast("long")

    names = ["v", "w", "o", "t", "pool", "c0", "c1", "kept", "ones", "twos"]

    def row(*columns: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip(columns, names, strict=True)])

    after = row(F.col("v"), none, zero, zero, pool, F.when(kept, F.col("o")).otherwise(0), F.when(kept, F.col("t")).otherwise(0), number(kept), number(pool == 1), number(pool == 2))
    before = row(F.col("w"), none, number(F.col("o") > 0), number(F.col("t") > 0), *[zero] * 6)
    itself = row(*(F.col(c) for c in "vwot"), *[zero] * 6)
    rows = F.when(F.col("w").isNull(), F.array(itself)).when(kept, F.array(after, before, itself)).otherwise(F.array(after, before))
    return pairs.select(F.explode(rows).alias("x")).select("x.*").groupBy("v", "w").agg(*[F.sum(n).alias(n) for n in names[2:]])


def _discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Count all labelled training rows and fit the curve; see the module's description."""
    rows = _training_rows(docs, labels)
    facts = stored(_facts(_pair_counts(rows.where("_fold <> 1"))))
    ends = facts.where("v is null").first()
    n = [ends["o"] or 0, ends["t"] or 0] if ends else [0, 0]
    share = (n[1] + 0.5) / (sum(n) + 2)
    model = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0, None, 0.0, float(np.log(share / (1 - share))))
    words = facts.where("v is not null and w is null")
    counts = ("o", "t")
    r = words.agg(
        *[f(F.col(c)).alias(f"{c}_{name}") for c in counts for name, f in (("sum", F.sum), ("types", lambda x: F.count_if(x > 0)), ("ones", lambda x: F.count_if(x == 1)), ("twos", lambda x: F.count_if(x == 2)))],
        F.count_if(F.col("o") + F.col("t") > 0).alias("types"),
        F.sum("ones").alias("ones"),
        F.sum("twos").alias("twos"),
    ).first()
    total = [r[f"{c}_sum"] or 0 for c in counts]
    if not all(n) or not all(total):
        return model
    least, pair_discount = float(min(total)), _discount(r["ones"], r["twos"])
    discounts = [_discount(r[f"{c}_ones"], r[f"{c}_twos"]) for c in counts]

    def p_word(k: int, o: Column, t: Column) -> Column:
        shared = (o + t + 1.0) / float(sum(total) + r["types"] + 1)
        return (F.greatest((o, t)[k] - discounts[k], F.lit(0.0)) + shared * (discounts[k] * r[f"{counts[k]}_types"] + least)) / (total[k] + least)

    def e_word(o: Column, t: Column) -> Column:
        return F.log(p_word(1, o, t)) - F.log(p_word(0, o, t))

    nothing = sum(total) + r["types"] + 1
    unknown = [(discounts[k] * r[f"{counts[k]}_types"] + least) / nothing / (total[k] + least) for k in (0, 1)]
    model.unknown = float(np.log(unknown[1]) - np.log(unknown[0]))

    pairs = facts.where("w is not null").select("v", "w", "o", "t")
    before = words.where("kept > 0").select(F.col("v").alias("_v"), "pool", "c0", "c1", F.col("c0") + F.col("c1") - F.col("kept") * pair_discount)
    before = before.toDF("_v", "pool", "c0", "c1", "explicit")
    last = words.select(F.col("v").alias("_w"), F.col("o").alias("n0"), F.col("t").alias("n1"))
    joined = pairs.join(before, F.col("v") == F.col("_v")).join(last, F.col("w") == F.col("_w"))
    share_of = (F.col("o") + F.col("t") - pair_discount) / F.col("explicit")

    def p_pair(k: int) -> Column:
        kept = F.col("explicit") / F.col("pool")
        own = (F.col(counts[k]) + share_of * STRENGTH) / (F.col(f"c{k}") + STRENGTH)
        return kept * own + (F.lit(1.0) - kept) * p_word(k, F.col("n0"), F.col("n1"))

    @F.arrow_udf("long")
    def pair_key(v: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(_pair_keys(v.to_numpy().view(np.uint64), w.to_numpy().view(np.uint64)).view(np.int64))

    pooled = F.col("o") + F.col("t")
    of_words = words.where(pooled > 0).select(F.col("v").alias("key"), e_word(F.col("o"), F.col("t")).alias("e"), pooled.alias("pooled"))
    of_pairs = joined.select("v", "w", (F.log(p_pair(1)) - F.log(p_pair(0))).alias("e"), pooled.alias("pooled"))
    table = stored(of_words.unionByName(of_pairs.select(pair_key("v", "w").alias("key"), "e", "pooled")))
    # the least count from which on at most HOT entries are left; counts of one size class stay together
    size = F.floor(F.log2(F.col("pooled").cast("double")) * 4).cast("int")
    least_size, above, all_sizes = None, 0, table.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()
    for x in all_sizes:
        if above + x["count"] > HOT:
            break
        above, least_size = above + x["count"], x["size"]
    if least_size is not None:
        hot = table.where(size >= least_size).select("key", "e").toArrow()
        order = np.argsort(hot["key"].to_numpy())
        model.keys, model.e = hot["key"].to_numpy()[order], hot["e"].to_numpy()[order]
    if above < sum(x["count"] for x in all_sizes):
        model.rest = (table.where(size < least_size) if least_size is not None else table).select("key", "e")
    _calibrate(model, rows.where("_fold = 1"), share)
    return model


def _calibrate(model: ToxicityModel, rows: DataFrame, share: float) -> None:
    """Fit score = 1 / (1 + exp(-(slope * evidence + intercept))) to a histogram of the evidence of rows that weren't counted.

    If those lack a class, the curve keeps a slope of 1 around the counted rows' share.
    """
    if model.rest is None:
        rows = rows.select(evidence_column(model, rows).alias("_e"), "_toxic", F.lit(1).alias("_n"))
    else:
        rows = _joined_evidence(model, rows, ["_toxic"]).select("_e", "_toxic", F.col("_rows").alias("_n"))
    half = BINS // 2 / REACH
    binned = rows.select(F.floor(F.least(F.greatest("_e", F.lit(-float(REACH))), F.lit(REACH - 1e-6)) * half).alias("bin"), "_toxic", "_n")
    table = binned.groupBy("bin").agg(F.sum(F.when(F.col("_toxic") <= 0, F.col("_n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("_toxic") > 0, F.col("_n")).otherwise(0)).alias("n1")).toPandas()
    x = (table["bin"].to_numpy(float) + 0.5) / half
    n0, n1 = table["n0"].to_numpy(float), table["n1"].to_numpy(float)
    if not n0.sum() or not n1.sum():
        model.slope = 1.0
        return
    scale = max(float(np.sqrt(np.average(x * x, weights=n0 + n1))), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    weights = np.zeros(2)
    for _ in range(100):  # Newton's steps with a small ridge, so that parted classes have an end too
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        gradient = design.T @ ((n0 + n1) * p - n1) + 1e-2 * weights * (1, 0)
        curvature = (design * ((n0 + n1) * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(curvature, gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        weights -= step
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.intercept = max(float(weights[0]) / scale, 0.0), float(weights[1])


def evidence_column(model: ToxicityModel, docs: DataFrame, text: str = "text") -> Column:
    """The evidence of texts, if all the model's entries are hot."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.keys, model.e))
    unknown = model.unknown

    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in text_chunks(texts):
            v, w, row = _words(data, offsets)
            e = _looked_up(*shipped.value, _pair_keys(v, w))
            open_ = np.flatnonzero(np.isnan(e))
            e[open_] = _looked_up(*shipped.value, w[open_])
            e[np.isnan(e)] = unknown
            out[lo:hi] = np.bincount(row, weights=e**3, minlength=hi - lo) / np.maximum(np.bincount(row, minlength=hi - lo), 1)
        return pa.array(out)

    return evidence(F.col(text))


def _content(text: str) -> tuple[Column, Column]:
    """Two hashes that name a text; a null one counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(1), t)


def _joined_evidence(model: ToxicityModel, docs: DataFrame, also: list[str], text: str = "text") -> DataFrame:
    """(_k1, _k2, `also`, _e, _rows): the evidence of each text and how many rows have it.

    A task settles what is hot. Every other pair of a text goes on with the hot e of its word, if there is one, and meets the rest
    first as a pair, then as a word. A row of a text has its hot sum and words; it carries the text's hash as keys and a count of
    0, so that these rows don't meet at one key. Equal texts add the same to both sums, which leaves their mean.
    """
    k1, k2 = _content(text)
    docs = docs.select(k1.alias("_k1"), k2.alias("_k2"), *also, F.col(text).alias("t"))
    shipped = docs.sparkSession.sparkContext.broadcast((model.keys, model.e))
    names = ["_k1", "_k2", *also, "pair", "word", "known", "n", "hot", "words"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = column_of(batch, "_k1").to_numpy()
            for lo, hi, data, offsets in text_chunks(column_of(batch, "t")):
                v, w, row = _words(data, offsets)
                pair = _pair_keys(v, w)
                e = _looked_up(*shipped.value, pair)
                open_ = np.flatnonzero(np.isnan(e))
                sums = np.bincount(row, weights=np.nan_to_num(e) ** 3, minlength=hi - lo)
                order = open_[np.lexsort((pair[open_], row[open_]))]
                row_, pair_, word = row[order], pair[order], w[order]
                first = np.flatnonzero(np.concatenate([[True], (row_[1:] != row_[:-1]) | (pair_[1:] != pair_[:-1])])) if len(order) else order
                n = np.diff(np.concatenate([first, [len(order)]]))
                row_, pair_, word = row_[first], pair_[first], word[first]
                known = _looked_up(*shipped.value, word)
                word = np.where(np.isnan(known), word, pair_)  # an odd key meets no word
                at = pa.array(np.concatenate([np.arange(lo, hi), row_ + lo]))
                own, none = one[lo:hi], np.full(hi - lo, np.nan)
                columns = [np.concatenate(x) for x in ([own, pair_.view(np.int64)], [own | 1, word.view(np.int64)], [none, known], [np.zeros(hi - lo, np.int64), n], [sums, np.zeros(len(n))], [np.bincount(row, minlength=hi - lo), np.zeros(len(n), np.int64)])]
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c).take(at) for c in names[: 2 + len(also)]), *map(pa.array, columns)], names)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in also)
    terms = docs.mapInArrow(rows, f"_k1 long, _k2 long, {kinds + ', ' if also else ''}pair long, word long, known double, n long, hot double, words long")
    terms = terms.join(model.rest.toDF("pair", "e_pair"), "pair", "left").join(model.rest.toDF("word", "e_word"), "word", "left")
    e = F.coalesce("e_pair", F.nanvl("known", F.lit(None).cast("double")), "e_word", F.lit(model.unknown))
    terms = terms.withColumn("hot", F.col("hot") + F.col("n") * e * e * e)
    out = terms.groupBy("_k1", "_k2", *also).agg(F.sum("hot").alias("h"), F.sum("words").alias("w"), F.count_if(F.col("n") == 0).alias("_rows"))
    return out.select("_k1", "_k2", *also, (F.col("h") / F.greatest("w", F.lit(1))).alias("_e"), "_rows")


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out`: how likely the text is toxic, from 0 to 1."""

    def curve(evidence: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(evidence * model.slope + model.intercept)))

    if model.rest is None:
        return docs.withColumn(out, curve(evidence_column(model, docs, text)))
    k1, k2 = _content(text)
    found = _joined_evidence(model, docs, [], text).select("_k1", "_k2", curve(F.col("_e")).alias(out))
    kept = docs.columns
    keyed = docs.withColumns({"_d1": k1, "_d2": k2})
    return keyed.join(found, (F.col("_d1") == F.col("_k1")) & (F.col("_d2") == F.col("_k2"))).select(*kept, out)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 where the score is 0.5 or more) of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
