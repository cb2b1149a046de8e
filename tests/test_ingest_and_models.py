"""Incremental ingestion, observed cascades and pluggable models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.operators import ensemble
from loomwork.sources import ingest


def test_batches_and_a_restart_give_the_table_of_one_batch(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    third = lambda n: docs.where(F.col("doc_id") % 3 == n).unionByName(docs.where("doc_id % 3 = 0").limit(5)).coalesce(1)  # noqa: E731 (some contents come again)
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    seen = []

    def features(new):
        seen.append({r["content_hash"] for r in new.select("content_hash").collect()})
        return new.withColumn("chars", F.length("text"))

    def run(features=features):
        ingest.ingest(spark, source, docs.schema, table, mark, F.col("text"), "doc_id", features, files_per_batch=1)

    third(0).write.parquet(source)
    run()
    third(1).write.mode("append").parquet(source)
    third(2).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="broken off"):
        run(lambda new: (_ for _ in ()).throw(RuntimeError("broken off")))
    run()
    run()  # nothing has come
    got = ingest.feature_table(spark, table, docs.schema)
    hashes = [r["content_hash"] for r in got.select("content_hash").collect()]
    want = {r[0] for r in docs.select(F.md5("text")).where(F.col("text").isNotNull()).distinct().collect()}
    assert len(hashes) == len(set(hashes)) and set(hashes) == want and got.select("batch").distinct().count() == 3
    assert sum(len(s) for s in seen) == len(want)  # features are made of new contents only, once each

    whole = str(tmp_path / "whole")
    ingest.ingest(spark, f"{small}/documents.parquet*", docs.schema, f"{whole}/table", f"{whole}/mark", F.col("text"), "doc_id")
    assert {r["content_hash"] for r in ingest.feature_table(spark, f"{whole}/table", docs.schema).collect()} == want


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None)], "id long, text string")
    add = ingest._added(str(tmp_path / "t"), F.col("text"), "id", None, rows.schema)
    add(rows, 0)
    add(rows, 0)
    add(rows.union(spark.createDataFrame([(9, "c")], rows.schema)), 1)
    assert sorted((r["batch"], r["id"], r["text"]) for r in ingest.feature_table(spark, str(tmp_path / "t"), rows.schema).collect()) == [(0, 1, "a"), (0, 3, "b"), (1, 9, "c")]


def test_counts_and_times_come_from_the_one_run(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("x"))
    jobs = spark.sparkContext._jsc.sc().dagScheduler()

    def cheap(batch):
        return batch["x"] >= 7

    def costly(batch):
        import time

        assert (batch["x"] >= 7).all()  # only rows that passed are shown
        time.sleep(0.01)
        return batch["x"] == 8

    result, observation = ensemble.observed_cascade(rows, "id", cheap, costly, ["x"])
    before = jobs.numTotalJobs()
    got = result.collect()
    facts = observation.get
    assert jobs.numTotalJobs() - before == 1
    assert (facts["seen"], facts["first"], facts["confirmed"], facts["demoted"]) == (1000, 300, 100, 200)
    assert facts["second_seconds"] >= 0.01 and 0 < facts["first_seconds"] < 60
    counts = ensemble.cascade_counts(result, []).first().asDict()
    assert counts == {k: facts[k] for k in ("seen", "first", "confirmed", "demoted")}
    assert {r["id"] for r in got if r["final"]} == {i for i in range(1000) if i % 10 == 8}


def test_missing_answers_of_an_observed_cascade(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id long, x double")
    result, observation = ensemble.observed_cascade(rows, "id", lambda b: b["x"] > 0, lambda b: pd.Series([None] * len(b)), ["x"])
    assert sorted(map(tuple, result.collect())) == [(1, True, False), (2, False, False), (3, True, False)] and observation.get["demoted"] == 2
    empty, observation = ensemble.observed_cascade(rows.where("id > 9"), "id", lambda b: b["x"] > 0, lambda b: b["x"] > 0, ["x"])
    assert empty.collect() == [] and observation.get["seen"] == 0


def test_a_model_sees_only_what_passed_the_cheap_test(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 7), [float(i), 1.0]) for i in range(200)], "id long, x double, v array<double>")
    log = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(log, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def predict(v: np.ndarray) -> np.ndarray:
            with open(os.path.join(log, f"seen-{uuid.uuid4().hex}"), "w") as f:
                f.write(",".join(str(int(a)) for a in v[:, 0]))
            return (v[:, 0] % 2 == 0).astype(float)

        return predict

    verdict = ensemble.model_verdict(load, ["v"], "id", batch_size=16, shapes=[[2]])
    out = ensemble.cascade(rows, "id", F.col("x") >= 5, verdict).select("id", "first", "final").collect()
    assert all(r["first"] == (r["id"] % 7 >= 5) and r["final"] == (r["first"] and r["id"] % 2 == 0) for r in out) and len(out) == 200
    seen = [int(i) for p in tmp_path.glob("seen-*") for i in p.read_text().split(",")]
    assert sorted(set(seen)) == [i for i in range(200) if i % 7 >= 5]
    workers = [p.name.split("-")[1] for p in tmp_path.glob("load-*")]
    assert workers and len(workers) <= len(list(tmp_path.glob("seen-*")))
