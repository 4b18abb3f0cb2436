"""Tables that are written on the way to a result, in a folder that driver and executors share."""

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset and all runs in this process
    (tests on one machine), a temporary folder is made and set. A cluster
    must name its folder: no machine's own would do.
    """
    there = spark.conf.get(_CHECKPOINT, None) or spark.sparkContext.getConf().get(_CHECKPOINT)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{_CHECKPOINT} must name a folder that the driver and all executors share")
        own = tempfile.TemporaryDirectory(prefix="foliolake-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        there = f"file://{own.name}"
        spark.conf.set(_CHECKPOINT, there)
    return there.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``stored`` wrote, through Spark's file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and its path.

    Later steps read whole files there, so a lost executor costs no lineage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliolake/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
