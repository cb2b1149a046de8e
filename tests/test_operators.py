"""Operators on small made cases: ties, empty groups, chains, odd values."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.functions import paths, vectors
from loomwork.operators import balance, bounded, dedup, ensemble, metrics, prototypes, sampling, scoring, sweep
from loomwork.sources import images


def test_argmax_and_topk_ties_go_to_the_lower_class(spark):
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "cls int, vec array<double>")
    items = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vec array<double>")
    row = scoring.class_scores(items, protos).select(scoring.best_class().alias("b"), scoring.top_classes(2).alias("t")).first()
    assert (row["b"], row["t"]) == (0, [0, 1])


def test_zero_vector_has_no_direction(spark):
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vectors.unit(F.col("v"))).first()[0] == [None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_bucket_sweep_is_the_naive_sweep(spark, seed):
    draw = random.Random(seed)
    rows = [("a", draw.choice([draw.random() * 1.2 - 0.1, draw.randrange(1001) / 1000]), draw.random() < 0.4) for _ in range(300)] + [("b", 0.29, True)]
    scores = spark.createDataFrame(rows, "cls string, sim double, y boolean")
    for r in sweep.fixed_sweep(scores, ["cls"], F.col("y")).collect():
        mine = [(s, y) for c, s, y in rows if c == r["cls"]]
        at = r["i"] / 1000
        assert (r["tp"], r["fp"], r["fn"]) == (sum(s >= at and y for s, y in mine), sum(s >= at and not y for s, y in mine), sum(s < at and y for s, y in mine))


def test_best_point_is_the_lowest_of_equal_ones(spark):
    scores = spark.createDataFrame([("a", 0.9, True), ("a", 0.1, False)], "cls string, sim double, y boolean")
    best = sweep.best_point(sweep.fixed_sweep(scores, ["cls"], F.col("y")), ["cls"]).first()
    assert best["f1"] == 1 and best["i"] == 101


def test_parted_scores_have_no_overlap(spark):
    scores = spark.createDataFrame([("a", 9.0, True), ("a", 1.0, False)], "cls string, sim double, y boolean")
    curve = sweep.overlap_sweep(scores, ["cls"], F.col("y"))
    assert curve.count() == 0 and sweep.best_or_zero(curve, ["cls"], scores.select("cls").distinct()).first()["f1"] == 0


def test_content_without_hash_is_kept_and_matches_nothing(spark):
    a = spark.createDataFrame([(1, "x", "p1"), (2, None, "p2"), (3, "y", "p3")], "o int, h string, path string")
    b = spark.createDataFrame([(1, "x", "q1"), (2, "x", "q2"), (3, None, "q3")], "o int, h string, path string")
    assert [(r["path"], r["matched"]) for r in dedup.content_duplicates(a, b, "h", "path", "o").collect()] == [("p1", "q2")]
    assert {r["path"] for r in dedup.content_keepers(a, b, "h").collect()} == {"p2", "p3"}


def test_banded_join_finds_all_pairs(spark):
    draw = random.Random(4)
    base = [draw.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << i for i in draw.sample(range(64), draw.randrange(8))) for b in base]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "hash long")
    got = {(r[0], r[1]) for r in dedup.hamming_pairs(df, df, 5).collect()}
    assert got == {(a, b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 5}


def test_greedy_clusters_are_the_walk(spark):
    draw = random.Random(9)
    hashes = [draw.getrandbits(20) & draw.getrandbits(20) & draw.getrandbits(20) for _ in range(80)]
    rows = [(i, h, draw.randrange(5)) for i, h in enumerate(hashes)]
    want, kept = {}, []
    for i, h, size in sorted(rows, key=lambda r: (-r[2], r[0])):
        want[i] = next((k for k, other in kept if (h ^ other).bit_count() <= 2), None)
        if want[i] is None:
            kept.append((i, h))
    df = spark.createDataFrame(rows, "id long, h long, size int")
    assert dict(map(tuple, dedup.greedy_clusters(df, "id", ["h"], [-F.col("size")], 2).collect())) == want


def test_a_chain_keeps_both_ends(spark):
    df = spark.createDataFrame([(1, 0b0), (2, 0b11111), (3, 0b1111111111)], "id long, h long")
    assert dict(map(tuple, dedup.greedy_clusters(df, "id", ["h"], [F.col("id")], 5).collect())) == {1: None, 2: 1, 3: None}


def test_quotas_add_up_and_items_are_dealt_once(spark):
    classes = spark.createDataFrame([(c,) for c in "abc"], "cls string")
    assert sorted(r["quota"] for r in sampling.even_quotas(classes, F.lit(11), F.col("cls")).collect()) == [3, 4, 4]
    requests = spark.createDataFrame([("x", 4, 1), ("y", 4, 2), ("z", 4, 3)], "who string, quota int, turn int")
    got = sampling.dealt(requests, spark.range(10).toDF("item"), [], "item", "s").collect()
    count = {w: sum(r["who"] == w for r in got) for w in "xyz"}
    assert count == {"x": 4, "y": 4, "z": 2} and len({r["item"] for r in got}) == 10


def test_balance(spark):
    classes = spark.createDataFrame([("a",), ("b",)], "cls string")
    rows = spark.createDataFrame([("a", "b")] * 3 + [("b", "a")] * 2, "target string, source string")
    assert balance.question_balance(rows, "target", classes).first()["balanced"]
    assert balance.question_balance(rows.limit(0), "target", classes).first()["balanced"]
    assert not balance.question_balance(rows.where("target = 'a'"), "target", classes).first()["balanced"]
    own = rows.unionByName(spark.createDataFrame([("a", "a")], rows.schema))
    assert {r["question"]: r["balanced"] for r in balance.source_balance(own, "target", "source", classes).collect()} == {"a": False, "b": True}


def test_few_shot_needs_complete_classes(spark):
    items = spark.createDataFrame([(i, i % 3 == 0) for i in range(9)], "id int, label boolean")
    with pytest.raises(ValueError):
        prototypes.few_shot(items, "label", "id", 5, complete=True).collect()


def test_unknown_to_one_model_did_not_pass_it(spark):
    a = spark.createDataFrame([(1, "n", 0.5, True, "p")], "cls int, name string, en_sim double, en_pass boolean, en_path string")
    b = spark.createDataFrame([(1, "m", 0.5, False, "q")], "cls int, name string, cn_sim double, cn_pass boolean, cn_path string")
    got = {r["name"]: (r["either"], r["source_path"]) for r in ensemble.union_of(a, b, ["cls", "name"]).collect()}
    assert got == {"n": (True, "p"), "m": (False, "q")}


def test_paths_and_answers(spark):
    row = spark.createDataFrame([("a/B/x.JPG", "Yesterday", "guitar12.jpeg")], "p string, a string, n string").select(
        paths.ending(F.col("p")), paths.folder(F.col("p")), paths.says_yes(F.col("a")), paths.numbered(F.col("n"), F.lit("Guitar")), paths.relative(F.col("p"), "a")
    )
    assert tuple(row.first()) == ("jpg", "B", True, 12, "B/x.JPG")


def test_report_of_absent_classes(spark):
    matrix = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "target int, pred int, n long")
    classes = spark.createDataFrame([(0,), (1,), (2,)], "cls int")
    report = {r["name"]: r["recall"] for r in metrics.classification_report(matrix, classes).collect()}
    assert report["0"] == 0.75 and report["2"] == 0 and report["accuracy"] == 0.75


def test_large_tables_are_not_taken_as_small(spark):
    with pytest.raises(ValueError):
        bounded.bounded(spark.range(11), 10)


def test_split_files_read_train_and_val(spark, tmp_path):
    for name in ("images/train/cat/a.jpg", "images/train/cat/b.PNG", "images/train/dog/c.jpeg", "images/train/dog/notes.txt", "images/val/cat/d.jpg"):
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x" * len(name))
    found = {split: sorted((r["label"], r["path"].rsplit("/", 1)[1]) for r in images.split_files(spark, str(tmp_path), split).collect()) for split in ("train", "val", "test")}
    assert found["train"] == [("cat", "a.jpg"), ("cat", "b.PNG"), ("dog", "c.jpeg")] and found["val"] == found["test"] == [("cat", "d.jpg")]
    assert images.split_files(spark, str(tmp_path / "none"), "train").count() == 0
    with pytest.raises(ValueError):
        images.split_files(spark, str(tmp_path), "other")


def test_class_questions_of_unknown_classes_are_errors(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "label string")
    asked = paths.class_question(F.col("label"), {"a": "Is it A?", "b": "Is it B?"})
    assert [r[0] for r in rows.select(asked).collect()] == ["Is it A?", None, "Is it B?"]
    with pytest.raises(Exception, match="no question for class c"):
        spark.createDataFrame([("c",)], "label string").select(asked).collect()
