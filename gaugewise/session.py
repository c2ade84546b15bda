"""Session set-up and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; cluster sizing stays with the caller."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Rows here are dear (many windows per row): keep small shuffles spread over all cores.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    # HotSpot never compiles a method above 8000 bytecodes; let Spark split such stages instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


# Wide plans make thousands of column calls; capturing the Python call site of each would dominate
# their build time. Static, so it belongs into the session builder.
BUILDER_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written stages: the cluster's checkpoint folder, else (tests) a local one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if "GAUGEWISE_TEST_DIR" not in os.environ:
            os.environ["GAUGEWISE_TEST_DIR"] = tempfile.mkdtemp(prefix="gaugewise-")
        folder = os.environ["GAUGEWISE_TEST_DIR"]
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute an input that has fewer splits than there are cores (a small single-row-group file
    would otherwise keep every narrow step in one task). Inputs with enough splits pass unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


#: A written stage is all that later stages read, so the shuffle files behind it may go once it is written.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """Write a stage as Parquet and read it back, so later stages neither recompute nor lose it.

    With ``more`` frames of the same columns the stage is their union, written one after the other: shuffle files of
    one are gone before the next begins."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    for stages in _NOTED[-1:]:
        stages.append(out)
    return out


_NOTED: list[list[DataFrame]] = []


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The stages written inside, for ``discard`` once what reads them is written itself."""
    _NOTED.append([])
    try:
        yield _NOTED[-1]
    finally:
        _NOTED.pop()


def discard(*stages: DataFrame) -> None:
    """Delete the folders of written stages (as ``cut`` returned them) whose last reader has ended; nothing that lies
    outside the folder of written stages is touched."""
    for df in stages:
        spark, files = df.sparkSession, df._jdf.inputFiles()
        path = spark._jvm.org.apache.hadoop.fs.Path
        if len(files):
            folder = path(files[0]).getParent()
            system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            if folder.getParent() == system.makeQualified(path(work_dir(spark))):
                system.delete(folder, True)
