"""Extensions on streams: the scene's object table kept up to date frame by frame, and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def object_state(observations: DataFrame, scene: str, key: str, time: str, attributes: list[str]) -> DataFrame:
    """For a stream or a table: attributes of the first frame, first and last frame and number of frames of each object.

    Only sums, extremes and one struct are kept for each object, so state grows with objects, not with frames."""
    return observations.groupBy(scene, key).agg(
        F.min_by(F.struct(*attributes), time).alias("first_seen"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("n_frames")
    ).select(scene, key, "first_seen.*", "first_time", "last_time", "n_frames")


def partial_state(observations: DataFrame, scene: str, key: str, time: str, attributes: list[str], flags: dict[str, Column]) -> DataFrame:
    """What a part of the observations says of each object: ``first`` (time and attributes of its first frame), last_time, n_frames,
    sorted timestamps, and for each flag whether any observation has it.  Parts can be merged in any order."""
    return observations.groupBy(scene, key).agg(
        F.min(F.struct(F.col(time).alias("first_time"), *attributes)).alias("first"), F.max(time).alias("last_time"), F.count("*").alias("n_frames"),
        F.array_sort(F.collect_set(time)).alias("timestamps"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
    )


def merged_state(parts: DataFrame, scene: str, key: str, flags: list[str]) -> DataFrame:
    """One part of several ones."""
    return parts.groupBy(scene, key).agg(
        F.min("first").alias("first"), F.max("last_time").alias("last_time"), F.sum("n_frames").alias("n_frames"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("timestamps")))).alias("timestamps"), *[F.bool_or(n).alias(n) for n in flags],
    )


def id_lists(state: DataFrame, scene: str, key: str, flags: list[str]) -> DataFrame:
    """Sorted ids of a scene's objects with each flag (``name``) and without it (``no_name``)."""
    lists = [F.array_sort(F.collect_list(F.when(c, F.col(key)))).alias(n) for f in flags for n, c in ((f, F.col(f)), (f"no_{f}", ~F.col(f)))]
    return state.groupBy(scene).agg(*lists)


class SceneTable:
    """A table of objects below a folder that micro-batches add to, each exactly once, however often it is repeated.

    A batch writes what it says of its objects to a folder of its own number; a batch that runs again after a failure overwrites it.
    Every ``every`` batches the last base and the batches since are merged to a new base, which is made of the same inputs if it is
    made again.  Readers take the newest finished base and the batches after it.  State is held by files, not in memory, and a batch
    costs what its own objects cost."""

    def __init__(self, spark: SparkSession, folder: str, scene: str, key: str, time: str, attributes: list[str], flags: dict[str, Column], every: int = 20):
        self.spark, self.folder, self.scene, self.key, self.time, self.attributes, self.flags, self.every = spark, folder.rstrip("/"), scene, key, time, attributes, flags, every

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the finished folders of a kind, ascending."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        store = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(top):
            return []
        found = [s.getPath() for s in store.listStatus(top)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _parts(self, upto: int | None = None, base_before: int | None = None) -> DataFrame | None:
        bases = [n for n in self._numbers("base") if base_before is None or n < base_before]
        base = bases[-1] if bases else -1
        batches = [n for n in self._numbers("batch") if n > base and (upto is None or n <= upto)]
        paths = [f"{self.folder}/base/{base}"] * (base >= 0) + [f"{self.folder}/batch/{n}" for n in batches]
        return self.spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        partial_state(batch, self.scene, self.key, self.time, self.attributes, self.flags).write.mode("overwrite").parquet(f"{self.folder}/batch/{number}")
        if (number + 1) % self.every == 0:
            merged_state(self._parts(number, number), self.scene, self.key, list(self.flags)).write.mode("overwrite").parquet(f"{self.folder}/base/{number}")

    def read(self) -> DataFrame | None:
        """The objects as of the last finished batch; None before there is one."""
        parts = self._parts()
        return None if parts is None else merged_state(parts, self.scene, self.key, list(self.flags))

    def follow(self, observations: DataFrame, checkpoint: str) -> StreamingQuery:
        """Adds what has arrived on a stream, in its micro-batches, and ends."""
        return observations.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, length: str, slide: str | None, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum by window of event time (tumbling, or sliding with ``slide``) and keys; late rows beyond ``late`` are dropped on streams.

    Times without zone are taken as UTC, as a watermark asks for."""
    at = events.withColumn("_t", F.col(time).cast("timestamp"))
    at = at.withWatermark("_t", late) if late and events.isStreaming else at
    window = F.window("_t", length, slide) if slide else F.window("_t", length)
    return at.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], value: str, late: str | None = None) -> DataFrame:
    """Count and sum by session: runs of events with less than ``gap`` between them."""
    at = events.withColumn("_t", F.col(time).cast("timestamp"))
    at = at.withWatermark("_t", late) if late and events.isStreaming else at
    return at.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
