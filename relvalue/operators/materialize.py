"""Write an intermediate table once, for plans that read it several times."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_owner: ContextVar[str | None] = ContextVar("owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without one gets a temporary folder; on a cluster that is an error,
    since a machine-local folder would not survive the machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="relvalue-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path: its file system and the path there."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), there


@contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    """A folder that holds all tables written in this block and goes with it, however the block ends.

    What is built from the tables must be written elsewhere, or read, within the block.
    """
    path = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
    token = _owner.set(path)
    try:
        yield path
    finally:
        _owner.reset(token)
        system, there = file_system(spark, path)
        system.delete(there, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of the surrounding ``owned`` block, or else in the shared folder.

    Later reads prune columns, and a lost executor costs re-reading files, not the whole plan.
    """
    spark = df.sparkSession
    path = f"{(_owner.get() or shared_dir(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
