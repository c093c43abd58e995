"""Session settings, table access and lineage cuts, in one place."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", memory: str = "8g", partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session to the operators."""
    conf = SETTINGS | {"spark.master": master, "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.driver.host": "127.0.0.1"} | extra
    spark = SparkSession.builder.appName("lanternfish").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where a session names none (tests on one machine), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="lanternfish-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Removes the shuffle files of a query when it ends, instead of when the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them back.

    A written table survives the loss of any executor, is columnar (later reads prune columns) and has a known size,
    so the optimizer broadcasts it only where it is really small. The shuffle files behind it are removed as soon as it is written, as nothing
    reads them again. The table itself is removed by ``release``, at the end of the ``tables`` scope it was made in, or with the session's process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanternfish-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    for scope in _scopes[-1:]:
        scope.append(path)
    out = spark.read.parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``cut`` that nothing will read again; other frames are left alone."""
    for t in tables:
        if (path := getattr(t, "_cut_path", None)) is not None:
            _remove(t.sparkSession, path)


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """A scope for one query: the tables that ``cut`` made in it are removed at its end, so a long session doesn't fill the disk. Results have to be taken inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session's JVM may be gone before this
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
