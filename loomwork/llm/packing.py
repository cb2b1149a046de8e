"""Packing documents into sequences by shortest-pack-first over the histogram of lengths.

Each document becomes the ids of a tokenizers file and an end id. It is cut into pieces of `capacity` ids and a shorter
rest. Then only the histogram of piece lengths (at most `capacity` rows) reaches the driver, where whole groups of equal
lengths are placed at once, longest first, each into the shortest packs that still have room, so that the packs with equal
contents are one packing pattern with a count. Every length then has ranges of ranks for the slots that the patterns give
it, and a piece finds its sequence by its rank among the pieces of its length. Ranks are counted in salted parts, so that a
very common length isn't ordered by one task.

Defined cases: a null or empty text has only the end id; a very long text is encoded whole by the task that reads it and then cut into pieces; repeated rows are packed as often as they stand; a null doc_id
stays null; an empty table gives no rows; other columns are ignored. Each document's `start`s cover it without a gap.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.shared import checkpointed

END_ID = 1
#: Words whose ids a Python worker remembers, from task to task (under 200 MB).
REMEMBERED = 700_000
#: Pieces of one length that one task orders, about; the number of parts follows from it.
PART = 1 << 16

_WHITE = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_PYTHON_ONLY = re.compile("[\x1c-\x1f]")


_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of whole texts. The tokenizer drops white space and looks at nothing across it, so words are encoded once each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        # a special token parts the words of one call, as it is cut out before anything else is done to a text
        self.part = next((t for t in ("<|startoftext|>", "<|endoftext|>") if self.tokenizer.token_to_id(t) is not None), None)
        # which ids end a word, if the vocabulary marks that
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def _joined(self, words: list[str], joint: str) -> np.ndarray:
        """The fast way gives the same ids, but doesn't work out where in the text they stand."""
        return np.array(self.tokenizer.encode_batch_fast([joint.join(words)], add_special_tokens=False)[0].ids, "<u4")

    def _remember(self, words: list[str], ids: np.ndarray, begins: list[int], ends: list[int]) -> None:
        self.known.update(zip(words, map(ids.tobytes().__getitem__, map(slice, begins, ends)), strict=True))

    def _by_last_ids(self, words: list[str]) -> bool:
        """Remember words of letters, joined by spaces: each has one id that ends a word, or more if it is cut, so as many as words are one each. Else False."""
        ids = self._joined(words, " ")
        ends = 4 * np.flatnonzero(self.last[ids]) + 4
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            return False
        self._remember(words, ids, [0, *ends[:-1].tolist()], ends.tolist())
        return True

    def _learn(self, new: set[str]) -> None:
        """Remember the ids of words. What stands before a tail of signs is a word to the tokenizer too, so both are looked up alone."""
        cut = {}
        for word in new:
            stem = word.rstrip(_TAIL)
            if len(stem) < len(word) and stem[-1:].isalpha() and "<|" not in word:
                cut[word] = stem, word[len(stem) :]
        known = self.known
        whole = {w for w in new if w not in cut} | {p for pair in cut.values() for p in pair if p not in known}
        plain = [w for w in whole if self.part and "<|" not in w]
        lettered = [w for w in plain if w.isalpha()]
        rest = [w for w in plain if not w.isalpha()]
        for at in range(0, len(lettered), 2_000):
            words = lettered[at : at + 2_000]
            if not self._by_last_ids(words):
                rest += words
        for at in range(0, len(rest), 2_000):
            words = rest[at : at + 2_000]
            ids = self._joined(words, self.part)
            parts = 4 * np.flatnonzero(ids == self.tokenizer.token_to_id(self.part))
            if len(parts) != len(words) - 1:
                raise ValueError("the tokenizer doesn't part words at its special token")
            begins, ends = [0, *(parts + 4).tolist()], [*parts.tolist(), 4 * len(ids)]
            self._remember(words, ids, begins, ends)
        for word in whole.difference(plain):
            known[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        for word, (stem, tail) in cut.items():
            known[word] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit numbers."""
        words = [_WHITE.findall(x) if _PYTHON_ONLY.search(x) else x.split() for x in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        self._learn(set().union(*words).difference(known))
        return [b"".join(map(known.__getitem__, x)) for x in words]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """The encoder of this process. A Python worker serves many tasks, and a function that is sent to it can't keep anything from one to the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece."""
    end = np.array([END_ID], "<u4").tobytes()

    @F.arrow_udf("struct<tokens:long,crcs:array<long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        tokens, crcs = [], []
        texts = pc.fill_null(texts, "")
        for at in range(0, len(texts), 200):
            for ids in encoder(path).encode(texts.slice(at, 200).to_pylist()):
                ids = memoryview(ids + end)
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + 4 * capacity]) for i in range(0, len(ids), 4 * capacity)])
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["tokens", "crcs"])

    cut = docs.select("doc_id", pieces(F.col("text")).alias("t")).select("doc_id", F.col("t.tokens").alias("doc_tokens"), F.posexplode("t.crcs").alias("i", "ids_crc32"))
    start = F.col("i").cast("long") * capacity
    return cut.select("doc_id", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - start).alias("length"), "ids_crc32", "doc_tokens")


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(count, [(length, times), ...] longest first) of every pattern; no pattern holds more than `capacity`.

    Each length splits at most one pattern and begins at most two, so there are at most 3 * capacity of them.
    """
    by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = max((r for r, packs in by_room.items() if packs), default=0)
        while left > 0:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:  # nothing has room: new packs, each with one of them
                by_room[capacity - length].append((left, ((length, 1),)))
                room = capacity - length
                if room >= length:  # later ones of this length may share these packs
                    count, pack = by_room[room].pop()
                    times = capacity // length
                    full, rest = divmod(left, times)
                    if full:
                        by_room[capacity - times * length].append((full, ((length, times),)))
                    if rest:
                        by_room[capacity - rest * length].append((1, ((length, rest),)))
                break
            count, pack = by_room[room].pop()
            take = min(count, left)
            if count > take:
                by_room[room].append((count - take, pack))
            last, times = pack[-1]
            grown = (*pack[:-1], (length, times + 1)) if last == length else (*pack, (length, 1))
            by_room[room - length].append((take, grown))
            left -= take
    return [(count, list(pack)) for packs in by_room.values() for count, pack in packs]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length, in order of rank: first rank, packs, first sequence, first offset; sorted by (length, rank)."""
    rows, base, given = [], 0, defaultdict(int)
    for count, pack in patterns:
        offset = 0
        for length, times in pack:
            rows.append((length, given[length], count, base, offset))
            given[length] += count * times
            offset += length * times
        base += count
    rows.sort()
    at = np.array(rows, np.int64).reshape(-1, 5)
    return {"key": (at[:, 0] << 48) + at[:, 1], "rank": at[:, 1], "count": at[:, 2], "base": at[:, 3], "offset": at[:, 4]}


def pack(pieces: DataFrame, capacity: int = 2048, part: int = PART) -> DataFrame:
    """`pieces` with sequence_id and offset."""
    kept = checkpointed(pieces.withColumn("_salt", F.xxhash64("doc_id", "start", "ids_crc32")))
    # so many parts that even if all pieces had one length no task would order more than a few times `part` of them
    salts = -(-kept.count() // part) + 1
    salted = kept.withColumn("_salt", F.pmod("_salt", F.lit(salts)))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = salted.sparkSession.sparkContext.broadcast(_slots(packing_patterns(histogram, capacity)))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        s = slots.value
        length, rank = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(s["key"], (length << 48) + rank, "right") - 1
        turn, copy = np.divmod(rank - s["rank"][at], s["count"][at])
        return pa.StructArray.from_arrays([pa.array(s["base"][at] + copy), pa.array(s["offset"][at] + turn * length)], ["sequence_id", "offset"])

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(within)).join(parts, ["length", "_salt"])
    placed = ranked.withColumn("_at", place(F.col("length"), F.col("_before") + F.col("_r") - 1))
    return placed.select(*pieces.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def shortest_pack_first(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document with its place; see the module's description."""
    packed = pack(token_pieces(docs, path, capacity), capacity)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
