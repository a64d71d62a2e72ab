"""Streams of saved states: running summaries and the plateau detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """States as they are saved in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def summaries(states: DataFrame, by: list[str], value: str) -> DataFrame:
    """Number of states, least, greatest and total value; partial sums only are kept as state."""
    return states.groupBy(*by).agg(F.count("*").alias("n_states"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"))


def keep_table(stream: DataFrame, target: str, checkpoint: str):
    """Writes what each batch changed, the touched keys only, as a version of the table, until what is there has been read. A batch that is
    run again writes its version again, so nothing is counted twice; :func:`kept` reads each key's newest row."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={n}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def kept(spark: SparkSession, target: str, by: list[str]) -> DataFrame:
    """A kept table: of each key the row of its newest version."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c != "version"]
    values = [c for c in names if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), "version").alias("__v")).select(*by, *[F.col(f"__v.{c}").alias(c) for c in values]).select(*names)


def compact(spark: SparkSession, source: str, target: str, by: list[str]) -> None:
    """Writes a kept table as one version, the newest, in another folder, in which later batches go on."""
    last = spark.read.parquet(source).agg(F.max("version")).first()[0]
    kept(spark, source, by).write.mode("overwrite").parquet(f"{target}/version={last}")


class _Plateau(StatefulProcessor):
    """The last stride - 1 values and the length of the present run by series; a series whose plateau was found keeps its mark only."""

    def __init__(self, by: list[str], least: float, slope: float, stride: int, occurrence: int) -> None:
        self.by, self.least, self.slope, self.stride, self.occurrence = by, least, slope, stride, occurrence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "y double")
        self.run = handle.getValueState("run", "length int, found boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        run, found = self.run.get() if self.run.exists() else (0, False)
        if found:
            return
        recent = [y for (y,) in self.recent.get()] if self.recent.exists() else []
        at, points = None, pd.concat(list(rows)).sort_values("idx")
        for idx, y in zip(points["idx"], points["y"]):
            before = y if self.stride == 1 else recent[0] if len(recent) == self.stride - 1 else None
            flat = y < self.least or (before is not None and before != 0 and 1 - y / before < self.slope * self.stride)
            run = run + 1 if flat else 0
            recent = (recent + [float(y)])[-(self.stride - 1):] if self.stride > 1 else []
            if run >= self.occurrence:
                at = int(idx)
                break
        self.run.update((run, at is not None))
        if at is not None:
            self.recent.clear()
            yield pd.DataFrame({c: [k] for c, k in zip(self.by, key)} | {"at": pd.array([at], dtype="Int32")})
        elif recent:
            self.recent.put([(y,) for y in recent])

    def close(self) -> None:
        pass


def plateaus(points: DataFrame, by: list[str], least: float = 1e-3, slope: float = 1e-6, stride: int = 100, occurrence: int = 10) -> DataFrame:
    """Per series the first ``idx`` at which the value ``y`` has been flat ``occurrence`` times in a row, emitted once.
    Points of a series must arrive in order of ``idx`` over batches; within one batch they are sorted."""
    kinds = {f.name: f.dataType for f in points.schema.fields}
    out = T.StructType([T.StructField(c, kinds[c]) for c in by] + [T.StructField("at", T.IntegerType())])
    grouped = points.select(*by, "idx", "y").groupBy(*by)
    return grouped.transformWithStateInPandas(_Plateau(by, least, slope, stride, occurrence), out, "append", "none")


def collect_to(stream: DataFrame, target: str, checkpoint: str):
    """Appends what a stream emits to a table, until what is there has been read. State is kept in RocksDB, so it need not fit in memory."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, before)
    return query
