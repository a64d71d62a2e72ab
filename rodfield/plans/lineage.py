"""Cutting the lineage of iterative plans, and tables that many queries share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The state of the source and the path of each table made, by session, source and name.
_made: dict[tuple[str, str, str], tuple[str, str]] = {}
#: Paths of the tables that each shared table under way has stored so far.
_under_way: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which every executor sees. One of our own is made only where none is
    named and all runs on one machine, as in tests."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the session names."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same by a table in that folder: packed, where a checkpoint keeps rows as they are in memory, and with a size that Spark knows, so that
    small ones are broadcast and large ones beside them stay where they are. What a shared table has stored on its way is deleted once it is written."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    if _under_way:
        _under_way[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def _state(spark: SparkSession, table: str) -> str:
    """Names, sizes and times of a table's files, so that a table that is written anew counts as another."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def shared(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], table: str = "embeddings.parquet") -> DataFrame:
    """What is derived from a source's table, written once a session in the shared folder and read by all queries that need it, until one
    of that table's files changes. The first query that needs it runs the job while its plan is built."""
    key = (spark.sparkContext.applicationId, source, name)
    state = _state(spark, f"{source}/{table}")
    if _made.get(key, ("", ""))[0] != state:
        token = spark.sql("SELECT uuid()").first()[0]
        path = f"{shared_folder(spark)}/{name}-{token}"
        _under_way.append([])
        try:
            build().write.parquet(path)
        finally:
            for old in _under_way.pop():
                _delete(spark, old)
        _made[key] = (state, path)
    return spark.read.parquet(_made[key][1])


def forget(spark: SparkSession, source: str | None = None) -> None:
    """Deletes the session's shared tables of a source, or all; plans that read them end."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId and source in (None, k[1])]:
        _delete(spark, _made.pop(key)[1])
