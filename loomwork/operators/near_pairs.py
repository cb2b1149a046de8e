"""Near pairs of hashes: every hash goes to the bands it may share with a near one, and each band's hashes are compared where they meet, as arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pairs that a task compares at once, and rows of whole bands that it collects for that.
BLOCK, ROWS = 1 << 19, 1 << 16
#: Earlier neighbours that are told of an item in one band.
LISTED = 64
#: The low bits of a meeting place hold the number of its band, the others are mixed from what the hash holds there.
_NUMBER, _MIX = np.int64(0xFFFF), np.int64(0x1E3779B97F4A7C15)


def slice_masks(distance: int, clean: int, bits: int = 64) -> list[int]:
    """The bits, as signed numbers, of every choice of `clean` (fewer for few bits) of distance + clean slices: hashes within the distance agree in one."""
    n = max(min(distance + clean, bits), 1)
    ends = [bits * i // n for i in range(n + 1)]
    masks = [sum((1 << ends[i + 1]) - (1 << ends[i]) for i in chosen) for chosen in combinations(range(n), max(n - distance, 0))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_decided(items: DataFrame, hashes: list[str], first: int, distance: int) -> DataFrame:
    """(late, early): items near each other by any hash, `first` or later ones with those before; for each band only the earliest that is near."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, h, item in _whole_places(batches):
            yield from _batches(_with_decided(place, h, item, first, distance), "late", "early")

    return _met(items, hashes, distance).mapInArrow(compared, "late long, early long")


def near_pairs(items: DataFrame, hashes: list[str], distance: int, listed: int = LISTED) -> DataFrame:
    """(late, early, cut): items near each other by any hash, once for each hash.

    Of more than `listed` earlier ones in a band the first are told, the last of them marked as `cut`; the others are told as pairs with themselves.
    """
    masks = _masks(distance)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, h, item in _whole_places(batches):
            yield from _batches(_with_earlier(place, h, item, distance, masks, listed), "late", "early", "cut")

    return _met(items, hashes, distance).mapInArrow(compared, "late long, early long, cut boolean")


def _masks(distance: int) -> np.ndarray:
    return np.array(slice_masks(distance, 2), np.int64)


def _met(items: DataFrame, hashes: list[str], distance: int) -> DataFrame:
    """(place, hash, item): every hash of the items (item, *hashes) once for each band, all of a place together and in order."""
    masks = _masks(distance)
    numbers = np.arange(len(hashes) * len(masks), dtype=np.int64).reshape(len(hashes), -1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = np.repeat(batch.column(0).to_numpy(), len(masks))
            for i, column in enumerate(batch.columns[1:]):
                h = column.to_numpy()
                place = (h[:, None] & masks) * _MIX & ~_NUMBER | numbers[i]
                yield from _batches([(place.ravel(), np.repeat(h, len(masks)), item)], "place", "hash", "item")

    return items.select("item", *hashes).mapInArrow(spread, "place long, hash long, item long").repartition("place").sortWithinPartitions("place", "item")


def _batches(rows: Iterable[tuple[np.ndarray, ...]], *names: str) -> Iterator[pa.RecordBatch]:
    for columns in rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], list(names))


def _whole_places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows as arrays (place, hash, item) that end where a place ends."""
    held, size = [], 0
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        place = columns[0]
        size += len(place)
        cut = np.searchsorted(place, place[-1]) if len(place) and size >= ROWS else 0
        if cut:
            held.append([c[:cut] for c in columns])
            yield _joined(held)
            held, size = [], len(place) - cut
        held.append([c[cut:] for c in columns])
    if size:
        yield _joined(held)


def _joined(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    place, h, item = (np.concatenate(c) for c in zip(*parts, strict=True))
    return place, h.view(np.uint64), item


def _with_decided(place, h, item, first, distance):
    """What `near_decided` tells, from whole places in order."""
    begin, open_ = _begins(place), item >= first
    before = np.concatenate([[0], np.cumsum(~open_)])
    decided = before[np.searchsorted(begin, begin, "right")] - before[begin]
    rows = np.flatnonzero(open_ & (decided > 0))
    for late, early in _pairs(rows, begin[rows], decided[rows]):
        near = np.bitwise_count(h[late] ^ h[early]) <= distance
        late, early = late[near], early[near]
        new = _begins(late) == np.arange(len(late))
        yield item[late[new]], item[early[new]]


def _with_earlier(place, h, item, distance, masks, listed):
    """What `near_pairs` tells, from whole places in order."""
    begin = _begins(place)
    count = np.arange(len(place)) - begin
    rows = np.flatnonzero(count)
    for late, early in _pairs(rows, begin[rows], count[rows]):
        differ = h[late] ^ h[early]
        near = np.bitwise_count(differ) <= distance
        late, early, differ = late[near], early[near], differ[near].view(np.int64)
        # a pair that meets in several bands is told in the first of them
        agreed = np.full(len(late), len(masks))
        for b in range(len(masks) - 1, -1, -1):
            agreed[differ & masks[b] == 0] = b
        told = agreed == (place[late] & _NUMBER) % len(masks)
        late, early = late[told], early[told]
        turn = np.arange(len(late)) - _begins(late)
        last = np.concatenate([late[1:] != late[:-1], [True]])[: len(late)]
        kept = turn < listed
        yield item[late[kept]], item[early[kept]], ((turn == listed - 1) & ~last)[kept]
        untold = item[np.unique(early[~kept])]
        yield untold, untold, np.zeros(len(untold), bool)


def _begins(values: np.ndarray) -> np.ndarray:
    """For each of the sorted values, where the first equal one stands."""
    new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
    return np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))


def _pairs(rows: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other): each row with the `count` others from `begin` on, all of a row in one block."""
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + BLOCK, "right")), at + 1)
        n = count[at:to]
        shift = begin[at:to] - (ends[at:to] - n - done)
        yield np.repeat(rows[at:to], n), np.repeat(shift, n) + np.arange(n.sum())
        at = to
