"""Perceptual hashes without a shuffle of words, and Hamming joins that never broadcast their bands."""

import random
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from loomwork.operators import dedup
from loomwork.plans import cleaning


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hashes_of(texts):
    """The three hashes of the words of all texts."""
    words = [w for t in texts for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    out = []
    for place in cleaning.HASHES.values():
        lead = [0] * 64
        for w in words:
            b = (int(md5(w.encode()).hexdigest()[:6], 16) >> (16 - 4 * (place - 1))) % 128
            lead[b % 64] += 1 if b < 64 else -1
        value = sum(1 << i for i, x in enumerate(lead) if x > 0)
        out.append(value - (1 << 64) if value >> 63 else value)
    return tuple(out)


def test_words_are_counted_where_their_text_is_read(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choice(["Straße", "é", "word", "A-b", "42", f"x{draw.randrange(99)}"]) for _ in range(draw.randrange(1, 80))) for _ in range(60)]
    rows = [(i % 50 if i != 7 else None, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " .,! ")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = cleaning.perceptual_hashes(df, "id", "text")
    want = {k: hashes_of([t for j, t in rows if j == k]) for k in {k for k, _ in rows} - {900, 901, 902}}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want
    assert "Generate" not in plan(got)  # no row for a word


def test_no_table_of_bands_is_broadcast(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    assert "Broadcast" not in plan(dedup.hamming_pairs(df, df, 5))


@pytest.mark.parametrize(("distance", "bits"), [(5, 64), (2, 64), (5, 56), (1, 3), (3, 2), (0, 64)])
def test_each_near_pair_once(spark, distance, bits):
    draw = random.Random(distance * 100 + bits)
    base = [draw.getrandbits(bits) for _ in range(30)]
    values = {v ^ sum(1 << i for i in draw.sample(range(bits), draw.randrange(min(bits, 8)))) for v in base for _ in range(8)} | set(base) | {0}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in [*values, *values, None]], "hash long")
    got = [tuple(r) for r in dedup.hamming_pairs(df, df, distance, bits=bits).collect()]
    want = [(a, b) for a in values for b in values if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance]
    assert sorted(got) == sorted(want)
