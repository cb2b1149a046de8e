"""Perceptual hashes of grey grids (arrays of side * side numbers, row by row): cosine, gradient and wavelet.

A separable transform is one step done twice: every row is multiplied by the transform's matrix and the result is transposed, so the
second time the columns are transformed and the grid comes out upright. All of it is array functions in the row at hand; nothing is shuffled.
A grid of another size, or null, gives a null hash. Bits are numbered from the grid's first cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_matrix(side: int) -> list[list[float]]:
    """Rows k of the cosine transform without scaling: 2 cos(pi k (2 n + 1) / (2 side))."""
    return [[2 * math.cos(math.pi * k * (2 * n + 1) / (2 * side)) for n in range(side)] for k in range(side)]


def haar_matrix(side: int, steps: int) -> list[list[float]]:
    """`steps` rounds of halving: sums and differences of neighbours over the square root of 2, sums first; each round works on the sums of the one before."""
    if side % (1 << steps):
        raise ValueError(f"{side} cells can't be halved {steps} times")
    rows = [[float(i == j) for j in range(side)] for i in range(side)]
    half = math.sqrt(0.5)
    for step in range(steps):
        n = side >> step
        pairs = [(rows[2 * i], rows[2 * i + 1]) for i in range(n // 2)]
        sums = [[(x + y) * half for x, y in zip(a, b, strict=True)] for a, b in pairs]
        differences = [[(x - y) * half for x, y in zip(a, b, strict=True)] for a, b in pairs]
        rows[:n] = sums + differences
    return rows


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often and wherever the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(matrix: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in matrix])


def transformed_once(grid: Column, matrix: list[list[float]]) -> Column:
    """matrix * transpose(grid): cell (k, r) is row k of the matrix times row r of the grid."""
    side = len(matrix)

    def dots(rows: Column) -> Column:
        return F.flatten(F.transform(_literal(matrix), lambda m: F.transform(rows, lambda row: F.aggregate(F.zip_with(m, row, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))))

    return _let(_rows(grid, side, side, side), dots)


def transformed(grid: Column, matrix: list[list[float]]) -> Column:
    """matrix * grid * transpose(matrix)."""
    return transformed_once(transformed_once(grid, matrix), matrix)


def _rows(grid: Column, width: int, height: int | Column, take: int, first: int = 1) -> Column:
    """`take` cells of each row, from the first-th on."""
    places = F.sequence(F.lit(0), (height if isinstance(height, Column) else F.lit(height)) - 1)
    return _let(grid, lambda g: F.transform(places, lambda r: F.slice(g, r * width + first, F.lit(take))))


def corner(grid: Column, side: int, keep: int) -> Column:
    """The first `keep` cells of the first `keep` rows."""
    return F.flatten(_rows(grid, side, keep, keep)) if keep < side else grid


def median(values: Column) -> Column:
    """The middle value, or the mean of the two."""
    return _let(F.array_sort(values), lambda v: (F.get(v, ((F.size(v) - 1) / 2).cast("int")) + F.get(v, (F.size(v) / 2).cast("int"))) / 2)


def packed_bits(flags: Column) -> Column:
    """A whole number with bit i set where flag i (of at most 64) is true."""
    return F.aggregate(
        F.transform(flags, lambda f, i: F.when(f, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)
    )


def _sized(grid: Column, side: int, result: Column) -> Column:
    return F.when(F.size(grid) == side * side, result)


def above_median(values: Column) -> Column:
    """Bits of the values above their median."""
    return _let(values, lambda v: packed_bits(_let(median(v), lambda m: F.transform(v, lambda x: x > m))))


def cosine_hash(grid: Column, side: int, keep: int = 8) -> Column:
    """The lowest keep * keep frequencies of the cosine transform, each against their median."""
    return _sized(grid, side, above_median(corner(transformed(grid, cosine_matrix(side)), side, keep)))


def gradient_hash(grid: Column, width: int) -> Column:
    """Of every cell but the last in its row, whether the next one is brighter: height * (width - 1) bits, 64 at most."""
    height = (F.size(grid) / width).cast("int")
    rows = F.zip_with(_rows(grid, width, height, width - 1), _rows(grid, width, height, width - 1, 2), lambda here, there: F.zip_with(here, there, lambda a, b: b > a))
    return F.when((F.size(grid) > 0) & (F.size(grid) % width == 0) & (F.size(grid) <= 64 * width / (width - 1)), packed_bits(F.flatten(rows)))


def wavelet_hash(grid: Column, side: int, steps: int, keep: int = 8) -> Column:
    """The first keep * keep cells of the Haar transform against their median. After log2(side / keep) steps these are the
    image in small; after more they are all its bands, and then the overall brightness (the first cell) counts as 0."""
    bands = corner(transformed(grid, haar_matrix(side, steps)), side, keep)
    if side >> steps < keep:
        bands = F.transform(bands, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x))
    return _sized(grid, side, above_median(bands))


# ---- the same in SQL


def _number(x: float) -> str:
    return f"{x!r}" if "e" in repr(x) else f"{x!r}e0"


def transformed_sql(grid: str, matrix: list[list[float]]) -> str:
    """The transform of a list of a DuckDB query."""
    side = len(matrix)
    rows = ", ".join("[" + ", ".join(map(_number, row)) + "]" for row in matrix)
    for _ in range(2):
        grid = f"flatten(list_transform([{rows}], lambda m: list_transform(range(0, {side}), lambda r: list_sum(list_transform(list_zip(m, ({grid})[r * {side} + 1:r * {side} + {side}]), lambda q: q[1] * q[2])))))"
    return grid


def bits_sql(flags: str) -> str:
    """A list of truth values as a whole number."""
    return f"coalesce(list_bit_or(list_transform({flags}, lambda f, i: case when not f then 0 when i = 64 then -9223372036854775808 else (2::hugeint ** (i - 1)) end::bigint)), 0)"
