"""Exact search and the fixity audit."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import voronoi, warc_fixity


def brute_topk(rows, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            new = [float(np.floor(256 * float(np.float32(x)))) for x in v]
            usable[i] = min(usable.get(i, new), new)
    out = []
    for q in usable:
        if q % 50 == 0:
            scores = sorted((-int(sum(a * b for a, b in zip(usable[q], v, strict=False))), i) for i, v in usable.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"pivots": 7, "group_queries": 1, "block_rows": 50}])
def test_topk(spark, small, limits):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding").collect()]
    got = voronoi.voronoi_topk(table, F.col("vec_id") % 50 == 0, **limits)
    assert sorted(map(tuple, got.collect())) == brute_topk(rows)


def test_topk_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (50, [0.5, 0.5]), (None, [1.0, 1.0]), (7, [-3.0, 2.0])]
    table = spark.createDataFrame([(i, v, 9, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cell int, v string, q_cell int")
    assert sorted(map(tuple, voronoi.voronoi_topk(table, F.col("vec_id") % 50 == 0).collect())) == brute_topk(rows)
    assert voronoi.voronoi_topk(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert voronoi.voronoi_topk(table.where("vec_id = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_audit_finds_changed_missing_and_added_records(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}" if i % 7 else None, "x" * (i % 50) if i % 11 else None, 1) for i in range(300)] + [(5, "http://a/5", "xxxxx", 1)], "page_id long, url string, html string, ordinal int")
    records = warc_fixity.warc_records(pages)
    assert warc_fixity.audit(records, records, 8).count() == 0
    faulty = warc_fixity.with_planted_faults(records)
    got = {(r["page_id"], r["status"]) for r in warc_fixity.audit(records, faulty, 8).collect()}
    assert {p for p, s in got if s == "changed"} == {13, 110, 207, 5, 106} and {p for p, s in got if s == "missing"} == {7, 96, 185, 274} and {p for p, s in got if s == "added"} == {3, 86, 169, 252}
    shorter = warc_fixity.audit(records, records.where("page_id < 298"), 8)
    assert {(r["page_id"], r["status"]) for r in shorter.collect()} == {(298, "missing"), (299, "missing")}
    longer = warc_fixity.audit(records.where("page_id < 298"), records, 8)
    assert {(r["page_id"], r["status"]) for r in longer.collect()} == {(298, "added"), (299, "added")}
    assert warc_fixity.audit(records.limit(0), records.limit(0)).count() == 0


def test_audit_locates_faults_that_move_what_follows(spark):
    rows = [(i * 1000 - 30000, f"block {i}") for i in range(300)] + [(5, "one"), (5, "two"), (5, "two"), (None, "lost"), (None, "stays"), (None, "stays")]
    faulty = [(p, b[:5] if p == 20000 else b) for p, b in rows if p not in (-29000, 70000)] + [(20001, "extra"), (5, "three"), (1 << 60, "far")]
    faulty.remove((5, "two"))
    faulty.remove((5, "two"))
    faulty.remove((None, "lost"))
    a, b = (spark.createDataFrame(x, "page_id long, block string") for x in (rows, faulty))
    got = warc_fixity.audit(a, b, 8).collect()
    want = {(-29000, "missing"), (70000, "missing"), (20000, "changed"), (20001, "added"), (5, "changed"), (5, "missing"), (None, "missing"), (1 << 60, "added")}
    assert {(r["page_id"], r["status"]) for r in got} == want and len(got) == len(want)
    orders = [sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())) for x in (rows, faulty)]
    for r in got:
        order = orders[r["status"] == "added"]
        assert order[r["ordinal"]][0] == r["page_id"] and r["octets"] == len(order[r["ordinal"]][1])
        assert r["offset"] == sum(len(x[1]) for x in order[: r["ordinal"]])
    assert warc_fixity.audit(a, a, 8).count() == 0


def test_levels_shrink_by_the_fan_out_on_sparse_ids(spark):
    """Random ids of 62 bits and records without any: numbers follow the manifest, so no level is nearly as large as the one below."""
    draw = np.random.default_rng(7)
    rows = [(int(i), f"block {i}") for i in np.unique(draw.integers(0, 1 << 62, 900))] + [(None, f"alone {i}") for i in range(100)]
    records = spark.createDataFrame(rows, "page_id long, block string")
    levels = warc_fixity.merkle_levels(warc_fixity.page_leaves(warc_fixity.laid_out(records)).withColumnRenamed("first", "ordinal"), 10)
    assert [x.count() for x in levels] == [1000, 100, 10, 1]
    hurt = [(p, "broken" if i == 500 else b) for i, (p, b) in enumerate(rows) if i not in (3, 950)] + [((1 << 62) + 5, "new"), (None, "new alone")]
    got = sorted((str(r["page_id"]), r["status"]) for r in warc_fixity.audit(records, spark.createDataFrame(hurt, records.schema), 10).collect())
    assert got == sorted([(str(rows[500][0]), "changed"), (str(rows[3][0]), "missing"), ("None", "missing"), (str((1 << 62) + 5), "added"), ("None", "added")])


def test_a_page_with_very_many_records(spark):
    rows = [(1, f"record {i % 700}") for i in range(3000)] + [(2, "other")]
    records = spark.createDataFrame(rows, "page_id long, block string")
    got = warc_fixity.audit(records, spark.createDataFrame(rows[1:], records.schema)).collect()
    assert [(r["page_id"], r["status"]) for r in got] == [(1, "missing")]


def test_tree_is_the_hash_of_its_parts(spark):
    records = spark.createDataFrame([(i, f"block {i}") for i in range(20)], "page_id long, block string")
    levels = warc_fixity.merkle_levels(warc_fixity.laid_out(records), 4)
    at, leaves = 0, []
    for i in range(20):
        block = f"block {i}".encode()
        leaves.append(hashlib.sha256(f"{at}:{len(block)}:{hashlib.sha256(block).hexdigest()}".encode()).hexdigest())
        at += len(block)
    while len(leaves) > 1:
        leaves = [hashlib.sha256("".join(leaves[i : i + 4]).encode()).hexdigest() for i in range(0, len(leaves), 4)]
    root = levels[-1].collect()
    assert len(root) == 1 and root[0]["hash"] == leaves[0] and (root[0]["begin"], root[0]["end"]) == (0, at)


def test_voronoi_bounds_exclude_data_of_other_clusters(spark):
    """Twenty tight clusters: a group of queries gets a small share of the data, and results are those of brute force."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    vectors = centres[draw.integers(0, 20, 3000)] + 0.01 * draw.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    usable = voronoi._usable(df, "vec_id", "embedding")
    whole = np.floor(256 * vectors)
    norm2 = float((whole**2).sum(1).max())
    chosen = voronoi._lifted(whole[:60], norm2, False)
    data, queries, groups = voronoi._parted(usable, F.col("vec_id") % 50 == 0, chosen, 16, norm2, 5, 4096, 8192)
    copies = data.select(F.sum(F.size("wanted"))).first()[0]
    assert len(groups) > 5 and copies / len(groups) < 0.3 * 3000
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in voronoi.voronoi_topk(df, F.col("vec_id") % 50 == 0).collect()}
    scores = (whole @ whole.T).astype(np.int64)
    want = {}
    for q in range(0, 3000, 50):
        order = sorted((i for i in range(3000) if i != q), key=lambda i: (-scores[q, i], i))[:5]
        want |= {(q, r + 1): (i, int(scores[q, i])) for r, i in enumerate(order)}
    assert got == want
