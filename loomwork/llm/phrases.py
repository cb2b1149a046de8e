"""Phrases that occur together more often than their parts: level-wise counting, then cuts scored from the level tables.

A phrase of k words can only be frequent if both phrases of k-1 words in it are. So words are counted first, and each further level
only counts phrases whose two overlapping parts were frequent on the level before. What a level finds goes out to all tasks
as a bit table (two bits for each frequent phrase, at most `TABLE_BITS` in all, 32 MB): a phrase that isn't frequent may slip
through it and is dropped by its own count, a frequent one can't be lost, and if more are frequent than the table can tell apart it only
prunes less. Words are counted by themselves. If two of them share a 64-bit hash, they are counted again under another one. From then on a word is its hash and a phrase is an array of them, so counts are exact, and only the phrases that can be
among the best get their words back.

A task joins equal phrases of 1 MB of text, and these again in groups of `HELD` or `HELD_PHRASES` rows, before anything is shuffled.
Places whose two parts of 2 words passed follow each other in long runs, in copied passages above all. Equal runs are joined over all
tasks and stored with their number, and phrases of 3 words and more are counted from the different runs: a passage that stands in n texts gives
its phrases once, not once for each task that meets it, and the texts are read once less.

Defined cases: a null text is empty; a null lang is `und`, an empty one stays; repeated rows count as often as they stand; ties of
scores are broken by count and words, so ranks are unique; an empty table gives no rows; doc_id and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import byte_values, column_of, mix, ranges, span_hashes, text_chunks, word_bounds
from loomwork.storage import stored

#: Bits of the largest table of frequent phrases that is sent to all tasks (32 MB).
TABLE_BITS = 1 << 28
#: Rows of counts that a task gathers before it joins equal ones and gives them out: of words, and of phrases, few of which are equal.
HELD, HELD_PHRASES = 1 << 19, 1 << 17
#: Words of runs that a task gathers before it joins equal runs (8 MB), and the most places of a run: a longer one is cut.
HELD_RUN_WORDS, RUN_PLACES = 1 << 20, 64
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True


def _turned(hashes: np.ndarray, word: int) -> np.ndarray:
    """Hashes with their bits turned by 21 places for each word before this one."""
    left = np.uint64(21 * word % 64)
    return (hashes << left) | (hashes >> (np.uint64(64) - left)) if word else hashes


def _turned_column(words: Column, word: int) -> Column:
    value, left = F.get(words, F.lit(word)), 21 * word % 64
    return F.shiftleft(value, left).bitwiseOR(F.shiftrightunsigned(value, 64 - left)) if word else value


def _keys(hashes: np.ndarray, k: int) -> np.ndarray:
    """A key of the k words from each word on, whether a break lies between them or not; others may share it."""
    n = len(hashes) - k + 1
    return reduce(np.bitwise_xor, [_turned(hashes[i : i + n], i) for i in range(k)]) if n > 0 else hashes[:0]


class Words:
    """The words of a chunk of texts: where they are, which of them follow each other in a piece, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int = 0):
        self.data = _LOWER[data]
        self.starts, self.ends, self.first = word_bounds(self.data, offsets, _APART)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        breaks = np.concatenate([[0], np.cumsum(_BREAK[self.data])])
        self.piece = breaks[self.starts] + self.row  # doesn't fall, and rises with every break and row
        values = span_hashes(byte_values(self.data), self.starts, self.ends)
        # a word's and a language's parts can't be exchanged
        self.hashes = mix(values + langs[self.row] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed)) if len(self.row) else values

    def keys(self, k: int) -> np.ndarray:
        return _keys(self.hashes, k)

    def whole(self, k: int) -> np.ndarray:
        """The words from which k words lie in one piece."""
        return np.flatnonzero(self.piece[k - 1 :] == self.piece[: max(len(self.piece) - k + 1, 0)])

    def counted(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places `at`, the first of each different phrase of k words, and how many have it."""
        keys = self.keys(k)[at]
        order = np.argsort(keys, kind="stable")
        words = [self.hashes[at + i] for i in range(k)]
        new = _changes([keys[order]])
        if k > 1 and (_changes([w[order] for w in words]) & ~new).any():  # two phrases share a key
            order = np.lexsort(words)
            new = _changes([w[order] for w in words])
        begin = np.flatnonzero(new)
        return at[order[begin]], np.diff(np.concatenate([begin, [len(order)]]))

    def runs(self, at: np.ndarray, k: int, more: int) -> pa.Array:
        """The words of the places `at`, as bytes, of those that follow each other in one row. A run of more than `RUN_PLACES` is cut; its parts
        but the last also hold up to `more` words of the next part, so that longer phrases that begin in them lie in them."""
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1])) if len(at) else at
        size = np.diff(np.concatenate([begin, [len(at)]]))
        part = (np.arange(len(at)) - np.repeat(begin, size)) % RUN_PLACES == 0
        left = np.repeat(begin + size, size)[part] - np.flatnonzero(part)  # places to the end of the run
        words = np.minimum(left, RUN_PLACES + more) + k - 1
        bounds = np.concatenate([[0], 8 * np.cumsum(words)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(self.hashes[ranges(at[part], words)].tobytes())])

    def texts(self, at: np.ndarray) -> pa.Array:
        begin, length = self.starts[at], self.ends[at] - self.starts[at]
        bounds = np.concatenate([[0], np.cumsum(length)])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(self.data[ranges(begin, length)].tobytes()))


def _changes(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the one before; the first one does."""
    changed = np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return changed


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(bits - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    has = np.ones(len(hashes), bool)
    for at in _bits(hashes, 8 * len(table)):
        has &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return has


def _table(frequent: DataFrame, k: int, most_bits: int) -> Broadcast:
    """The bit table of a level: bits are joined by 64 in Spark, and at most `most_bits` / 8 bytes come to the driver."""
    n = frequent.count()
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * n + 1)), 10, np.log2(most_bits)))
    key = reduce(lambda a, b: a.bitwiseXOR(b), [_turned_column(F.col("words"), i) for i in range(k)])
    low, high = F.col("key").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(bits - 1))
    at = frequent.select(key.alias("key")).select(F.explode(F.array(low, high)).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    got = at.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[got["word"].to_numpy()] = got["bit"].to_numpy()
    return frequent.sparkSession.sparkContext.broadcast(table.astype("<i8").view(np.uint8))


def _lang_values(langs: pa.Array) -> np.ndarray:
    """A number for each row's language, from its text."""
    data, offsets = np.concatenate([np.frombuffer(x.encode(), np.uint8) for x in langs.to_pylist()] or [np.zeros(0, np.uint8)]), np.cumsum([0, *(len(x.encode()) for x in langs.to_pylist())])
    return span_hashes(byte_values(data), offsets[:-1], offsets[1:])


def _chunks(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, list[str], Words]]:
    """(number of each row's language in the list, languages, words) of about 1 MB of text each."""
    coded = column_of(batch, "lang").dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    values = _lang_values(coded.dictionary)
    for lo, hi, data, offsets in text_chunks(column_of(batch, "text")):
        yield codes[lo:hi], names, Words(data, offsets, values[codes[lo:hi]], seed)


class _Held:
    """Counts of many chunks, joined where they are of the same phrase before they are given out."""

    def __init__(self, keys: list[str], schema: pa.Schema, most: int):
        self.keys, self.schema, self.most, self.tables, self.rows = keys, schema, most, [], 0

    def add(self, columns: list[pa.Array], weight: int | None = None) -> Iterator[pa.RecordBatch]:
        self.tables.append(pa.Table.from_arrays(columns, schema=self.schema))
        self.rows += len(columns[0]) if weight is None else weight
        if self.rows > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            joined = pa.concat_tables(self.tables).group_by(self.keys).aggregate([("n", "sum")]).rename_columns([*self.keys, "n"])
            self.tables, self.rows = [], 0
            yield from joined.select(self.schema.names).cast(self.schema).to_batches(1 << 14)
            del joined
            pa.default_memory_pool().release_unused()


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, n) of every word."""
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.large_string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(["h", "lang", "word"], schema, HELD)
        for batch in batches:
            for codes, names, words in _chunks(batch, seed):
                at, n = words.counted(words.whole(1), 1)
                yield from held.add([pa.array(words.hashes[at].view(np.int64)), pa.array(names, pa.string()).take(pa.array(codes[words.row[at]])), words.texts(at), pa.array(n)])
        yield from held.out()

    return texts.mapInArrow(count, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def _share_hashes(words: DataFrame) -> bool:
    """Whether two words have the same hash."""
    return words.groupBy("h").count().where(F.col("count") > 1).limit(1).count() > 0


def _phrase_counts(texts: DataFrame, k: int, before: Broadcast, seed: int) -> DataFrame:
    """(words, n) of the phrases of k words whose parts of k - 1 words passed the level before."""
    names = [f"w{i}" for i in range(k)]
    schema = pa.schema([*[(w, pa.int64()) for w in names], ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(names, schema, HELD_PHRASES)
        for batch in batches:
            for _, _, words in _chunks(batch, seed):
                at, part = words.whole(k), _marked(before.value, words.keys(k - 1))
                first, n = words.counted(at[part[at] & part[at + 1]], k)
                yield from held.add([*[pa.array(words.hashes[first + i].view(np.int64)) for i in range(k)], pa.array(n)])
        yield from held.out()

    return _summed(texts.mapInArrow(count, ", ".join(f"{w} long" for w in names) + ", n long"), names).select(F.array(*names).alias("words"), "n")


def _summed(counts: DataFrame, names: list[str]) -> DataFrame:
    """Dealt by key first: tasks have joined what they can, so a second hash table before the shuffle would only take memory."""
    return counts.repartition(*names).groupBy(*names).agg(F.sum("n").alias("n"))


def _runs(texts: DataFrame, k: int, before: Broadcast, seed: int, longest: int) -> DataFrame:
    """(run, n) of the different runs of places from which k words follow whose parts of k - 1 words passed the level before."""
    schema = pa.schema([("run", pa.large_binary()), ("n", pa.int64())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(["run"], schema, HELD_RUN_WORDS)
        for batch in batches:
            for _, _, words in _chunks(batch, seed):
                at, part = words.whole(k), _marked(before.value, words.keys(k - 1))
                found = words.runs(at[part[at] & part[at + 1]], k, longest - k)
                yield from held.add([found, pa.array(np.ones(len(found), np.int64))], found.nbytes // 8)
        yield from held.out()

    return _summed(texts.mapInArrow(runs, "run binary, n long"), ["run"])


def _phrases_in_runs(runs: DataFrame, least: int, k: int, before: Broadcast | None) -> DataFrame:
    """(words, n) of the phrases of k words in runs of places with `least` words each; `before`: only those whose parts of k - 1 words passed the level before."""
    names = [f"w{i}" for i in range(k)]
    schema = pa.schema([*[(w, pa.int64()) for w in names], ("n", pa.int64())])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(names, schema, HELD_PHRASES)
        for batch in batches:
            run, n = column_of(batch, "run").cast(pa.large_binary()), column_of(batch, "n").to_numpy()
            if not len(run):
                continue
            bounds = np.frombuffer(run.buffers()[1], np.int64, len(run) + 1, 8 * run.offset) // 8
            hashes = np.frombuffer(run.buffers()[2], np.uint64, bounds[-1] - bounds[0], 8 * int(bounds[0]))
            words = np.diff(bounds)
            # a place belongs to one run only, and the words after the last one are there for longer phrases
            places = np.maximum(np.minimum(np.minimum(words - least + 1, RUN_PLACES), words - k + 1), 0)
            at, n = ranges(bounds[:-1] - bounds[0], places), np.repeat(n, places)
            if before is not None:
                part = _marked(before.value, _keys(hashes, k - 1))
                passed = part[at] & part[at + 1]
                at, n = at[passed], n[passed]
            yield from held.add([*[pa.array(hashes[at + i].view(np.int64)) for i in range(k)], pa.array(n)])
        yield from held.out()

    return _summed(runs.mapInArrow(phrases, ", ".join(f"{w} long" for w in names) + ", n long"), names).select(F.array(*names).alias("words"), "n")


def frequent_phrases(docs: DataFrame, min_count: int = 30, longest: int = 4, table_bits: int = TABLE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words array<long>, n) of every phrase of 1 to `longest` words that occurs `min_count` times or more in its language,
    (h, lang, word) of the frequent words, whose hashes the phrases are made of, and (lang, total) with each language's number of words; all stored."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    seed = 0
    while _share_hashes(words := stored(_word_counts(texts, seed))):
        seed += 1
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("total")))
    often = words.where(F.col("n") >= min_count)
    levels = [often.select(F.array("h").alias("words"), "n")]
    for k in range(2, longest + 1):
        before = _table(levels[-1].select("words"), k - 1, table_bits)
        if k == 3:
            runs = stored(_runs(texts, k, before, seed, longest))
        counts = _phrase_counts(texts, k, before, seed) if k == 2 else _phrases_in_runs(runs, 3, k, before if k > 3 else None)
        levels.append(stored(counts.where(F.col("n") >= min_count)))
        before.unpersist()
    return reduce(DataFrame.unionByName, levels), often.select("h", "lang", "word"), totals


def scored_phrases(levels: DataFrame, scale: int = 2_000_000) -> DataFrame:
    """(words, a, l, r, score) of every frequent phrase of two words or more: the lowest scale * a / (l + r) of its cuts, of equal
    ones the first, in whole numbers of up to 38 digits."""
    counts = levels.select(F.col("words").alias("_part"), F.col("n").alias("_n"))
    k = F.size("words")
    cut = F.transform(F.sequence(F.lit(1), k - 1), lambda c: F.struct(c.alias("cut"), F.slice("words", F.lit(1), c).alias("left"), F.slice("words", c + 1, k - c).alias("right")))
    cuts = levels.where(k > 1).select("words", F.col("n").alias("a"), F.inline(cut))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts, F.col(part) == F.col("_part")).withColumnRenamed("_n", name).drop("_part", part)
    wide = "decimal(38,0)"
    scored = cuts.withColumn("score", F.expr(f"cast(cast({scale} as {wide}) * cast(a as decimal(20,0)) as {wide}) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as {wide})"))
    least = scored.groupBy("words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    return least.select("words", "a", "c.l", "c.r", F.col("c.score").cast("long").alias("score"))


def within_longer(levels: DataFrame, share: int = 80) -> DataFrame:
    """(words) of phrases that lie in a longer frequent one with at least `share` % of their count.

    Only phrases of one word more are looked at: whatever is longer still isn't more frequent than the one of them that it holds.
    """
    k = F.size("words")
    parts = F.array_distinct(F.array(F.slice("words", F.lit(1), k - 1), F.slice("words", F.lit(2), k - 1)))
    most = levels.where(k > 2).select(F.explode(parts).alias("words"), "n").groupBy("words").agg(F.max("n").alias("_most"))
    wide = "cast({} as decimal(38,0))"
    return levels.join(most, "words").where(F.expr(f"100 * {wide.format('_most')} >= {share} * {wide.format('n')}")).select("words")


def collocations(docs: DataFrame, min_count: int = 30, longest: int = 4, best: int = 2000, share: int = 80, table_bits: int = TABLE_BITS) -> DataFrame:
    """The `best` phrases of each language by score: (lang, rank, phrase, a, l, r, n, score)."""
    levels, words, totals = frequent_phrases(docs, min_count, longest, table_bits)
    kept = scored_phrases(levels).join(within_longer(levels, share), "words", "left_anti")
    kept = kept.join(words.select("h", "lang"), F.get("words", F.lit(0)) == F.col("h")).drop("h")
    # the best of each of many parts of a language first, so that no task ranks a whole language; ties stay until their words are known
    order = [F.desc("score"), F.desc("a")]
    kept = kept.withColumn("_part", F.pmod(F.xxhash64("words"), F.lit(64)))
    for by in (["lang", "_part"], ["lang"]):
        kept = kept.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= best)
    found = kept.select(*[c for c in kept.columns if c not in ("_part", "_r")], F.posexplode("words").alias("_i", "_h"))
    spelled = found.join(words.select(F.col("h").alias("_h"), "word"), "_h").groupBy("lang", "words", "a", "l", "r", "score")
    named = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


#: The same in DuckDB.
ORACLE_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') as ws from (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d)),
total as (select lang, sum(len(ws))::bigint as n from p group by lang having sum(len(ws)) > 0),
f as (select lang, k, phrase, count(*)::bigint as n from (
    select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from p, (select unnest([1, 2, 3, 4]) as k) where len(ws) >= k)
  ) group by lang, k, phrase having count(*) >= 30),
cut as (select lang, phrase, n as a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') as one, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') as two from f, (select unnest([1, 2, 3]) as c) where k > 1 and c < k),
s as (select cut.lang, cut.phrase, a, c, x.n as l, y.n as r, (2000000::hugeint * a) // (x.n::hugeint + y.n) as score from cut
  join f x on x.lang = cut.lang and x.phrase = one join f y on y.lang = cut.lang and y.phrase = two),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (select lang, k, n, string_split(phrase, ' ') as ws from f where k > 2),
inner_ as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(n) as most from (select lang, ws, n, m, unnest(range(1, k - m + 2)) as i from (select *, m from longer, (select unnest([2, 3]) as m) where m < k)) group by all),
kept as (select best.* from best left join inner_ on inner_.lang = best.lang and inner_.phrase = best.phrase where most is null or 100 * most::hugeint < 80 * a::hugeint),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang, rank::bigint as rank, phrase, a, l, r, total.n, score::bigint as score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""
