"""Lookups that must be complete, folder scans, and manifests that are carried out."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomwork.operators import lookups
from loomwork.sources import applied, images, sinks


def touch(folder, names):
    for name in names:
        file = folder / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(name.encode())


def test_a_missing_key_fails_the_query(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "path string, n int")
    table = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [3.0])], "path string, vec array<double>")
    assert sorted(map(tuple, lookups.complete_lookup(rows, table, "path", ["vec"]).collect())) == [("a", 1, [1.0]), ("a", 3, [1.0]), ("b", 2, [2.0])]
    for odd in ([("z", 9)], [(None, 9)]):
        more = rows.union(spark.createDataFrame(odd, rows.schema))
        for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("n").collect()):
            with pytest.raises(PySparkException, match="no key"):
                read(lookups.complete_lookup(more, table, "path", ["vec"]))


def test_a_class_without_files_fails_the_query(spark, tmp_path):
    touch(tmp_path, ["cat/a.jpg", "cat/b.WEBP", "dog/c.png", "dog/deep/d.jpg", ".hidden/e.png"])
    files = images.image_files(spark, str(tmp_path), recursive=False)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in images.visible(files).collect()) == ["a.jpg", "b.WEBP", "c.png"]
    classes = spark.createDataFrame([("pet", "cat"), ("pet", "dog"), ("wild", "wolf")], "target string, folder string")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    plan = images.mapped(files, classes)
    assert len(jobs.getJobIdsForGroup(None)) == before  # nothing is collected to find out
    for read in (lambda df: df.collect(), lambda df: df.count()):
        with pytest.raises(PySparkException, match="no files for wild"):
            read(plan)
    whole = images.mapped(files, classes.where("target = 'pet'"))
    assert whole.groupBy("target").count().collect()[0]["count"] == 4 - 1 == images.mapped(files, classes, allow_empty=True).count()


def test_files_by_a_condition(spark, tmp_path):
    touch(tmp_path, ["cat/a.jpg", "cat/notes.txt", "dog/longer.name.bin"])
    got = images.image_files(spark, str(tmp_path), is_valid_file=F.col("length") > 9)
    assert sorted(r["label"] for r in got.collect()) == ["cat", "dog"]
    with pytest.raises(ValueError):
        images.image_files(spark, str(tmp_path), endings=("jpg",), is_valid_file=F.lit(True))
    assert images.image_files(spark, str(tmp_path / "nowhere")).count() == 0


def moved(spark, folder, pairs):
    return spark.createDataFrame([(f"{folder}/{a}", f"{folder}/{b}") for a, b in pairs], "old_path string, new_path string")


def test_copies_are_logged_and_not_made_twice(spark, tmp_path):
    touch(tmp_path, ["in/a.jpg", "in/b.jpg", "in/c.jpg"])
    log, manifest = str(tmp_path / "log"), moved(spark, tmp_path, [(f"in/{x}.jpg", f"out/new/{x}.jpg") for x in "abcd"])
    assert {r["status"] for r in applied.apply_manifest(manifest, "copy", log).collect()} == {"would"} and not (tmp_path / "out").exists()
    first = {r["old_path"][-5]: r["status"] for r in applied.apply_manifest(manifest, "copy", log, dry_run=False).collect()}
    assert first == {"a": "done", "b": "done", "c": "done", "d": "failed"}
    stamp = os.stat(tmp_path / "out/new/a.jpg").st_mtime_ns
    touch(tmp_path, ["in/d.jpg"])
    again = applied.apply_manifest(manifest, "copy", log, dry_run=False).collect()
    assert [(r["old_path"][-5], r["status"]) for r in again] == [("d", "done")] and os.stat(tmp_path / "out/new/a.jpg").st_mtime_ns == stamp
    assert sorted(p.name for p in (tmp_path / "out/new").iterdir()) == ["a.jpg", "b.jpg", "c.jpg", "d.jpg"]
    copied = applied.applied_log(spark, log).where("status = 'done'")
    assert copied.count() == 4 and copied.agg(F.sum("bytes")).first()[0] == 4 * len("in/a.jpg")


def test_an_interrupted_move_goes_on(spark, tmp_path):
    """Files that an attempt has moved before it broke off, without a word in the log, are done; half a copy is done again."""
    touch(tmp_path, ["in/a.jpg", "in/b.jpg", "in/c.jpg"])
    (tmp_path / "out").mkdir()
    (tmp_path / "in/a.jpg").rename(tmp_path / "out/a.jpg")
    (tmp_path / "out/b.jpg.0000.part").write_bytes(b"in/")
    got = {r["old_path"][-5]: r["status"] for r in applied.apply_manifest(moved(spark, tmp_path, [(f"in/{x}.jpg", f"out/{x}.jpg") for x in "abc"]), "move", str(tmp_path / "log"), dry_run=False).collect()}
    assert got == {"a": "already", "b": "done", "c": "done"} and not list((tmp_path / "in").iterdir())
    assert (tmp_path / "out/b.jpg").read_bytes() == b"in/b.jpg"


def test_a_task_that_runs_twice_does_nothing_twice(tmp_path):
    touch(tmp_path, ["in/a.jpg"])
    old, new = f"{tmp_path}/in/a.jpg", f"file://{tmp_path}/out/a.jpg"
    for action, want in (("copy", ["done", "already"]), ("move", ["already"] * 0 + ["done", "already"]), ("delete", ["already", "already"])):
        assert [applied._carry_out(old, new if action != "delete" else None, action)[0] for _ in range(2)] == want
    touch(tmp_path, ["in/a.jpg", "in/other.jpg"])
    with pytest.raises(FileExistsError):  # another file is in the way of a move
        applied._carry_out(f"{tmp_path}/in/other.jpg", new, "move")


def test_colliding_names_are_refused(spark, tmp_path):
    touch(tmp_path, ["in/a.jpg", "in/b.jpg"])
    files = images.image_files(spark, str(tmp_path / "in"))
    manifest = sinks.rename_manifest(files, "path", F.lit(f"{tmp_path}/out/same.jpg"))
    with pytest.raises(ValueError, match="one name"):
        applied.apply_manifest(manifest, "move", str(tmp_path / "log"), dry_run=False)
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        applied.apply_manifest(manifest, "burn", str(tmp_path / "log"))


def test_deletions(spark, tmp_path):
    touch(tmp_path, ["in/a.jpg", "in/b.jpg"])
    manifest = images.image_files(spark, str(tmp_path / "in")).where(F.col("path").endswith("a.jpg")).select("path", F.lit("same content").alias("reason"))
    assert [r["status"] for r in applied.apply_manifest(manifest, "delete", str(tmp_path / "log"), dry_run=False).collect()] == ["done"]
    assert [p.name for p in (tmp_path / "in").iterdir()] == ["b.jpg"]
