"""Streaming operators drained over the events table, against the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.plans.fixtures import GAMMA, NOW
from mnemograph.sources import stores
from mnemograph.streaming import streams

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def particles(spark, sf_dir):
    return streams.events(spark, sf_dir).withColumn("mass", F.greatest(F.col("value") / 10, F.lit(0.01)))


@query("SELECT DISTINCT md5(event_type || '-' || CAST(user_id AS VARCHAR)) AS hash_id FROM events")
def st1_stream_dedupe(spark, sf_dir):
    """The watermark is wider than the table's month, so each text comes once."""
    e = streams.events(spark, sf_dir).withColumn("content", F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    return streams.drained(streams.deduplicated(e, "content", late="60 days")).select("hash_id")


@query("SELECT user_id AS id, event_id AS version, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def st2_stream_upsert(spark, sf_dir):
    e = streams.events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value")
    path = stores.shared_path(spark, "snapshots")
    q = streams.upserted(e, "id", "version", path).option("checkpointLocation", stores.shared_path(spark, "stream-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return streams.snapshot(spark, path, q.lastProgress["batchId"], spark.createDataFrame([], e.schema))


@query("SELECT user_id AS id, 'set' AS event, round(epoch_us(ts) / 1e6, 3) AS at, greatest(value / 10, 0.01) AS mass FROM events")
def st3_decay_state(spark, sf_dir):
    """Set events of the drained stream; evictions depend on the watermark's progress and are tested apart."""
    p = particles(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", "mass")
    d = streams.drained(streams.decay_states(p, GAMMA, late="60 days"))
    return d.where("event = 'set'").select("id", "event", F.round("at", 3).alias("at"), "mass")


WINDOWS = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id, round(sum(exp(-(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1e6 / 86400 / greatest(value / 10, 0.01))), 6) AS strength, count(*) AS n FROM events GROUP BY ALL"


@query(WINDOWS)
def st4_windowed_strength(spark, sf_dir):
    d = streams.drained(streams.windowed_strength(particles(spark, sf_dir), NOW, GAMMA), mode="complete")
    return d.select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", F.round("strength", 6).alias("strength"), "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def st1_stream_final_state(spark, sf_dir):
    """The deduplicated stream's final store, counted by event type."""
    e = streams.events(spark, sf_dir).withColumn("content", F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")))
    return streams.drained(streams.deduplicated(e, "content", late="60 days")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id % 10 AS part, count(*) AS n, max(event_id) AS newest FROM (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) GROUP BY 1")
def st2_stream_final_state(spark, sf_dir):
    """The upserted snapshot after the last batch, counted by a part of the key."""
    return st2_stream_upsert(spark, sf_dir).groupBy((F.col("id") % 10).alias("part")).agg(F.count("*").alias("n"), F.max("version").alias("newest"))


#: A faster decay, by which many states end within the table's month.
FAST = 1.0 / 3600


@query("""WITH l AS (SELECT user_id AS id, epoch_us(ts) / 1e6 AS born, greatest(value / 10, 0.01) AS mass FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
f AS (SELECT id, mass, born + mass * 3600 * ln(2 * mass / 1e-3) AS ends FROM l) SELECT id, round(ends, 3) AS at, mass FROM f WHERE floor(ends * 1000) < (SELECT floor(max(epoch_us(ts)) / 1000) FROM events)""")
def st3_evictions(spark, sf_dir):
    """States that time ends once the whole table has been read: the watermark then stands at the last event."""
    p = particles(spark, sf_dir).select(F.col("user_id").alias("id"), "ts", "mass")
    d = streams.drained(streams.decay_states(p, FAST, late="0 seconds"))
    return d.where("event = 'forgotten'").select("id", F.round("at", 3).alias("at"), "mass")
