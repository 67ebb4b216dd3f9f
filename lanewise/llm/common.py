"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.  Where the session names none: a local one if all tasks run in this process or on this
    machine's threads (tests), else an error, as executors elsewhere wouldn't see it."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables that ``settled`` has written in this process and ``forget`` hasn't removed.
_settled: list[str] = []


#: Spark then removes a statement's shuffle files when the statement is over.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, sweep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cut lineage that survives lost executors.

    Parquet instead of ``checkpoint()`` as it is compressed and read by column.  The table stays until ``forget``.
    ``sweep``: the shuffle files of this step go as soon as it is written, instead of when the driver collects its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    was = spark.conf.get(_SWEEP, "false")
    spark.conf.set(_SWEEP, "true" if sweep else was)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SWEEP, was)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *but: DataFrame) -> int:
    """Removes the tables that ``settled`` has written so far, except those that the named DataFrames read; returns how many.

    For the caller who knows that no other DataFrame still needs them, as between the stages of a pipeline."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in but for f in df.inputFiles()}
    gone = [p for p in _settled if p.rsplit("/", 1)[-1] not in kept]
    for path in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _settled.remove(path)
    return len(gone)


def remainder(doc_id: Column, parts: int = 4) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def bounded_batches(df: DataFrame, size: int = 4 << 20) -> DataFrame:
    """df, after the session's Arrow batches are bound by bytes instead of rows alone: texts differ widely in length.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` of the caller's session and leaves it set, as plans read it when they run."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df
