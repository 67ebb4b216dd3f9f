"""Readers and writers of the data model's files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ANSWER, ANSWER_TYPES, QUESTION, QUESTION_TYPES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_entities(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST", lines: bool = False) -> DataFrame:
    """A folder of JSON documents by an explicit schema: one entity a file, or with ``lines`` one a line, as ``write_entities`` writes
    them unless told otherwise.  PERMISSIVE keeps broken ones in _corrupt_record."""
    if mode == "PERMISSIVE":
        schema += ", _corrupt_record STRING"
    return spark.read.schema(schema).json(path, multiLine=not lines, mode=mode)


def with_file_stem(df: DataFrame) -> DataFrame:
    """Adds the file's name without its ending; for tables read from files."""
    return df.withColumn("file_stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def write_entities(df: DataFrame, path: str, mode: str = "errorifexists", one_a_file: bool = False) -> None:
    """JSON documents, one a line; ``one_a_file`` for tools that open each entity by itself, and for few of them."""
    writer = df.write.mode(mode)
    (writer.option("maxRecordsPerFile", 1) if one_a_file else writer).json(path)


def expect_files(spark: SparkSession, path: str, pattern: str, n: int) -> DataFrame:
    """path and length of the files below a folder; an error if there aren't n."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length")
    if (there := found.count()) != n:
        raise ValueError(f"{there} files {pattern} in {path}, expected {n}")
    return found


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of double-encoded files: a JSON object {tag, samples: [{question, answer}]} whose parts are strings of JSON."""
    raw = spark.read.schema("tag STRING, samples ARRAY<STRUCT<question: STRING, answer: STRING>>").json(path, multiLine=True, mode="FAILFAST")
    return raw.select("tag", F.inline("samples")).select("tag", F.from_json("question", QUESTION).alias("question"), F.from_json("answer", ANSWER).alias("answer"))


def known_types(samples: DataFrame, questions: tuple[str, ...] = QUESTION_TYPES, answers: tuple[str, ...] = ANSWER_TYPES) -> DataFrame:
    """Samples whose question and answer name a known kind; any other name, or none, is an error."""
    bad = ~(F.coalesce(F.col("question.question_type").isin(*questions), F.lit(False)) & F.coalesce(F.col("answer.answer_type").isin(*answers), F.lit(False)))
    said = F.concat_ws(", ", F.lit("unknown kind"), F.coalesce("question.question_type", F.lit("null")), F.coalesce("answer.answer_type", F.lit("null")))
    return samples.where(F.when(bad, F.raise_error(said)).otherwise(F.lit(True)))


def encoded_samples(samples: DataFrame) -> DataFrame:
    """value: one line of such a file for each tag.  For data sets of the size of a file; others stay as tables."""
    one = F.struct(F.to_json("question").alias("question"), F.to_json("answer").alias("answer"))
    return samples.groupBy("tag").agg(F.collect_list(one).alias("samples")).select(F.to_json(F.struct("tag", "samples")).alias("value"))


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    encoded_samples(samples).write.mode(mode).text(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """value: the trimmed, non-empty lines of a text list."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


#: Folders that ``scratch`` has named in this process and ``forget`` hasn't removed.
_scratch: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the session names for checkpoints; on this machine's threads alone a local one will do."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    _scratch.append(f"{folder.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _scratch[-1]


def forget(spark: SparkSession) -> int:
    """Removes what stands at the paths that ``scratch`` has named so far, tables of ``cut`` among them; returns how many.

    For the caller who knows that no DataFrame still reads them."""
    n = len(_scratch)
    for path in _scratch:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _scratch.clear()
    return n


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder that the session names for checkpoints and read again, for plans that read it several times;
    df itself where the session names none.  The table stays until ``forget``."""
    spark = df.sparkSession
    if not (spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        return df
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_list(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string")).write.mode(mode).text(path)


def write_batches(df: DataFrame, path: str, size: int, mode: str = "errorifexists") -> None:
    """JSON files of at most ``size`` rows; no sort, no shuffle."""
    df.write.mode(mode).option("maxRecordsPerFile", size).json(path)


def write_by(df: DataFrame, path: str, *columns: str, mode: str = "errorifexists") -> None:
    """JSON files by the values of columns, as generator and split."""
    df.write.mode(mode).partitionBy(*columns).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output stands at a path, of any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def once(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet at a path; made and written first if it isn't finished there."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def image_path(root: str, scene: Column, timestamp: Column, camera: Column) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/"), F.concat_ws("_", scene, timestamp.cast("string"), camera), F.lit(".jpg"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """path, point, values: rows of NumPy files, decoded batch by batch."""
    import io

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("point", pa.int64()), ("values", pa.list_(pa.float64()))])

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                points = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                for i in range(0, len(points), 10_000):
                    part = points[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array(part.tolist(), pa.list_(pa.float64()))], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(decode, "path string, point long, values array<double>")


def predicted(rows: DataFrame, columns: list[str], make_model, schema: str) -> DataFrame:
    """Rows through a model: make_model() is called once in each task and gives a function from a pandas batch to one of ``schema``."""

    def run(batches):
        model = make_model()
        for batch in batches:
            yield model(batch)

    return rows.select(*columns).mapInPandas(run, schema)


def scene_split(scenes: DataFrame, n_train: int, seed: str = "42") -> DataFrame:
    """scene_id and split, the first n by md5 for training."""
    from ..operators.sampling import split_by_count

    return split_by_count(scenes.select("scene_id").distinct(), n_train, seed, "scene_id")


