"""Structured Streaming forms of the incremental operators.

Each takes a streaming DataFrame and leaves trigger and sink to the caller;
drained() runs one over what its source holds now and returns the final table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemograph.functions import decay, text
from mnemograph.sources import stores

#: Lateness that is waited for.
LATE = "1 day"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time as timestamp, which watermarks ask for."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, column: str, time: str = "ts", late: str = LATE) -> DataFrame:
    """First row of each text, by content hash, within the watermark."""
    d = stream.withColumn("hash_id", text.hash_id(F.col(column)))
    return d.withWatermark(time, late).dropDuplicatesWithinWatermark(["hash_id"])


def windowed_strength(stream: DataFrame, now: str, gamma: float, length: str = "1 day", slide: str | None = None, session: str | None = None, late: str = LATE) -> DataFrame:
    """Strength at `now` summed per user in tumbling, sliding or session windows of birth time. stream(ts, user_id, mass)."""
    age = decay.age_seconds(F.col("ts"), F.lit(now))
    d = stream.withColumn("strength", decay.radius_at(F.lit(1.0), F.col("mass"), age, gamma)).withWatermark("ts", late)
    span = F.session_window("ts", session) if session else F.window("ts", length, slide) if slide else F.window("ts", length)
    out = d.groupBy(span.alias("span"), "user_id").agg(F.sum("strength").alias("strength"), F.count("*").alias("n"))
    return out.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "user_id", "strength", "n")


#: The state store that typed state and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DecayingParticle(StatefulProcessor):
    """One particle's newest event as typed state, and a timer at the moment at which it is forgotten."""

    def __init__(self, gamma: float):
        self.gamma = gamma

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.particle = handle.getValueState("particle", "born double, mass double")

    def ends(self, born: float, mass: float) -> float:
        """When the radius 2 * mass has fallen to the threshold."""
        return born + mass / self.gamma * log(2 * mass / decay.FORGET) if 2 * mass > decay.FORGET else born

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.particle.get() if self.particle.exists() else None
        newest = known
        for some in rows:  # one frame at a time: a busy particle's events are never all held
            last = some.loc[some["ts"].idxmax()]
            born = last["ts"].timestamp()
            if newest is None or born >= newest[0]:
                newest = (born, float(last["mass"]))
            yield pd.DataFrame({"id": [key[0]] * len(some), "event": ["set"] * len(some), "at": [t.timestamp() for t in some["ts"]], "mass": some["mass"].astype(float).tolist()})
        if newest is None or (known is not None and tuple(known) == tuple(newest)):
            return
        self.particle.update(tuple(newest))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(self.ends(*newest) * 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        born, mass = self.particle.get()
        self.particle.clear()
        yield pd.DataFrame({"id": [key[0]], "event": ["forgotten"], "at": [self.ends(born, mass)], "mass": [mass]})

    def close(self) -> None:
        pass


def decay_states(stream: DataFrame, gamma: float, late: str = LATE) -> DataFrame:
    """(id, event, at, mass): one state per particle; a newer event sets its mass anew, and time evicts it once forgotten.

    stream(id long, ts, mass). Emits `set` for each event and `forgotten` when the
    watermark passes the moment at which the radius 2 * mass falls under the threshold.
    The session must keep state in RocksDB; it is set here where no store is named.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, ROCKS)
    grouped = stream.select("id", "ts", "mass").withWatermark("ts", late).groupBy("id")
    return grouped.transformWithStateInPandas(DecayingParticle(gamma), "id long, event string, at double, mass double", "append", "eventTime")


def particle_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, born, mass) of the particles that a decay query's checkpoint holds, running or not."""
    d = spark.read.format("statestore").option("stateVarName", "particle").load(checkpoint)
    return d.select(F.col("key.id").alias("id"), "value.born", "value.mass")


#: Buckets of an upserted snapshot.
BUCKETS = 32


def upserted(stream: DataFrame, key: str, version: str, path: str, buckets: int = BUCKETS):
    """A stream writer that merges each micro-batch into the snapshot under path.

    Rows lie in buckets by the key's hash. A batch rewrites the buckets it touches and
    notes, in a manifest of one row a bucket, which batch holds which bucket now. A batch
    that runs again writes the same files again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        batch = stores.kept(batch.withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "micro-batch")
        touched = [r[0] for r in batch.select("bucket_").distinct().collect()]  # `buckets` values at most
        held = manifest(spark, path, number - 1) if number else {}
        old = read_buckets(spark, path, {b: n for b, n in held.items() if b in touched}, batch)
        new = stores.upsert(old, batch, key, version)
        new.repartition(min(buckets, max(len(touched), 1)), "bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/data/{number:08d}")
        now = held | {b: number for b in touched}
        spark.createDataFrame(sorted(now.items()) or [], "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number:08d}")

    return stream.writeStream.foreachBatch(merge)


def manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch holds each bucket after a batch."""
    return {r["bucket"]: r["batch"] for r in spark.read.parquet(f"{path}/manifest/{number:08d}").collect()}  # a row a bucket


def read_buckets(spark: SparkSession, path: str, held: dict[int, int], like: DataFrame) -> DataFrame:
    files = [f"{path}/data/{n:08d}/bucket_={b}" for b, n in sorted(held.items())]
    if not files:
        return like.limit(0)
    columns = [f for f in like.schema.fields if f.name != "bucket_"]
    d = spark.read.schema(T.StructType(columns)).parquet(*files)
    return d.withColumn("bucket_", F.regexp_extract(F.input_file_name(), r"bucket_=(\d+)", 1).cast("int")).select(like.columns)


def snapshot(spark: SparkSession, path: str, number: int, like: DataFrame) -> DataFrame:
    """The merged table after a batch, with the columns of `like`."""
    return read_buckets(spark, path, manifest(spark, path, number), like.withColumn("bucket_", F.lit(0))).select(like.columns)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives for all its source holds now, as a table in the shared folder."""
    spark = stream.sparkSession
    path, state = stores.shared_path(spark, "stream"), stores.shared_path(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:  # the last complete result replaces those before
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(path)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
