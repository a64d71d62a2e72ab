"""Streams that are stopped, resumed and repeated, and functions over groups in batches."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rodfield.functions import hooks
from rodfield.operators import series as S
from rodfield.plans import lineage
from rodfield.streaming import states as W

EVENTS = "k string, v double"


def event_file(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def told(df):
    return {r.k: (r.n_states, r.low, r.high, r.total) for r in df.collect()}


def test_kept_table_writes_touched_keys_only(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("source", "target", "marks"))

    def read():
        W.keep_table(W.summaries(W.read(spark, source, spark.createDataFrame([], EVENTS).schema), ["k"], "v"), target, marks)
        return spark.read.parquet(target)

    event_file(spark, source, [("a", 1.0), ("b", 2.0), ("c", 9.0)])
    assert read().count() == 3
    event_file(spark, source, [("b", 5.0), ("d", 1.0)])
    written = read()
    assert sorted(r.k for r in written.where(F.col("version") == 1).collect()) == ["b", "d"]
    whole = {"a": (1, 1.0, 1.0, 1.0), "b": (2, 2.0, 5.0, 7.0), "c": (1, 9.0, 9.0, 9.0), "d": (1, 1.0, 1.0, 1.0)}
    assert told(W.kept(spark, target, ["k"])) == whole
    # a batch that is written again changes nothing, and without new files nothing is
    again = spark.read.parquet(f"{target}/version=1").collect()
    spark.createDataFrame(again).write.mode("overwrite").parquet(f"{target}/version=1")
    read()
    assert told(W.kept(spark, target, ["k"])) == whole
    W.compact(spark, target, str(tmp_path / "short"), ["k"])
    assert spark.read.parquet(str(tmp_path / "short")).count() == 4 and told(W.kept(spark, str(tmp_path / "short"), ["k"])) == whole


def test_batches_of_a_group(spark):
    rows = spark.createDataFrame([("a", 0, i // 100, float(i)) for i in range(1000)] + [("b", 1, 3, -1.0)], "ensemble_id string, replica int, idx int, v double")

    def longest(batches):
        name, n, total = None, 0, 0.0
        for t in batches:
            name, n, total = t.iloc[0, 0], max(n, len(t)), total + t["v"].sum()
        yield pd.DataFrame({"name": [name], "n": [n], "total": [total]})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        schema = "name string, n long, total double"
        for made in (hooks.per_ensemble_in_batches(rows, longest, schema), hooks.per_simulation_in_batches(rows, longest, schema)):
            assert {r.name: (r.n <= 64, r.total) for r in made.collect()} == {"a": (True, 499500.0), "b": (True, -1.0)}
        assert hooks.per_state_in_batches(rows, longest, schema).count() == 11
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_shared_table_follows_its_source(spark, tmp_path):
    source = str(tmp_path)
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{source}/embeddings.parquet")
        for _ in range(2):
            assert lineage.shared(spark, source, "copy", lambda: spark.read.parquet(f"{source}/embeddings.parquet")).count() == n
    lineage.forget(spark, source)
    assert not [k for k in lineage._made if k[1] == source]
    assert lineage.shared(spark, source, "copy", lambda: spark.range(7)).count() == 7


def test_plateaus_go_on_after_a_stop(spark, tmp_path):
    """Points come in stretches; the stream is stopped and resumed from its checkpoint between them, in the middle of series."""
    rng = np.random.default_rng(4)
    rows = [(f"s{s}", 0, i, float(v)) for s in range(12) for i, v in enumerate(np.maximum(100.0 * 0.9 ** np.arange(60) + rng.normal(0, 0.2, 60), 0.1))]
    schema = "ensemble_id string, replica int, idx int, y double"
    points = spark.createDataFrame(rows, schema)
    source, target, marks = (str(tmp_path / n) for n in ("source", "target", "marks"))
    for start in range(0, 60, 7):
        points.where(F.col("idx").between(start, start + 6)).coalesce(1).write.mode("append").parquet(source)
        stream = W.read(spark, source, points.schema, 1)
        W.collect_to(W.plateaus(stream, ["ensemble_id", "replica"], 5.0, 0.01, 5, 4), target, marks)
    found = sorted((r.ensemble_id, r["at"]) for r in spark.read.parquet(target).collect())
    assert found == sorted((r.ensemble_id, r["at"]) for r in S.plateau(points, least=5.0, slope=0.01, stride=5, occurrence=4).where("at is not null").collect()) and found
