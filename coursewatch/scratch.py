"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own.

    Only where neither is set on a single machine, as in tests, a temporary one
    is made: other machines couldn't read it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        where = own.get()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="coursewatch-"))
        where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where.rstrip("/")


PACKED = "zstd"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; else they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def put(df: DataFrame, path: str, mode: str = "overwrite", *by: str) -> None:
    """Write a table packed, so that it takes about half the disk."""
    with shuffles_dropped(df.sparkSession):
        out = df.write.mode(mode).option("compression", PACKED)
        (out.partitionBy(*by) if by else out).parquet(path)


class Scratch:
    """Written tables that cut lineage, in the shared folder.

    A table is re-read from storage after the loss of any executor, and unlike
    a checkpoint of an RDD it is computed once and keeps its statistics.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/coursewatch-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.drop, self.root)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = self.path(name)
        put(df, path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str | None = None) -> None:
        """Delete a written table, or all of them: nothing may be read from it any more."""
        path = path or self.root
        try:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder is temporary
            pass
