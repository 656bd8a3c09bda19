"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import CorpusError

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder as the session names it; only where it names none and runs on one machine is a temporary one made and set."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise CorpusError(f"{CHECKPOINT_DIR} names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="scholium-")
        spark.conf.set(CHECKPOINT_DIR, path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` as a table of the shared folder, and its path: lineage ends there,
    so a lost executor costs a read, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, through the session's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that this process has written to the shared folder: for when no result is read any more."""
    while _made:
        remove(spark, _made.pop())
