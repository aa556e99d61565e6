"""Tables of the engine derived from the driver tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Evaluation time of all decay queries and decay rate per second; fixed values.
NOW = "2024-01-31 00:00:00"
GAMMA = 1.0 / 86400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as particles: a vector, a mass, a temperature and a birth time each."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding", "label")
    n = vectors.agg(F.max("vec_id") + 1).first()[0] or 1
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("created_at"), "value", (F.col("event_id") % n).alias("vec_id"))
    mass = F.greatest(F.col("value") / 10, F.lit(0.01))
    return events.join(vectors, "vec_id").select(
        "event_id", F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("id"), "user_id", "event_type", "created_at", "value", "vec_id", "label",
        F.col("embedding").alias("direction"), mass.alias("mass"), (1 + F.col("event_id") % 5).cast("double").alias("temperature"), (2 * mass).alias("initial_radius"),
    )


PARTICLES = """particles AS (
  SELECT e.event_id, 'p-' || e.event_id AS id, e.user_id, e.event_type, e.ts AS created_at, e.value, v.vec_id, v.label, CAST(v.embedding AS DOUBLE[]) AS direction,
         greatest(e.value / 10, 0.01) AS mass, CAST(1 + e.event_id % 5 AS DOUBLE) AS temperature, 2 * greatest(e.value / 10, 0.01) AS initial_radius,
         epoch_us(TIMESTAMP '2024-01-31 00:00:00') / 1e6 - epoch_us(e.ts) / 1e6 AS age
  FROM events e JOIN embeddings v ON e.event_id % (SELECT max(vec_id) + 1 FROM embeddings) = v.vec_id)"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, s, p, o): what each order states about customer, nation, region, parts and suppliers."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_suppkey")
    chunk = lambda key: F.concat(F.lit("chunk-"), F.md5(F.col(key).cast("string").cast("binary")))
    name = lambda kind, key: F.concat(F.lit(kind + " "), F.col(key).cast("string"))
    customers = t("customer").select("c_custkey", "c_nationkey")
    nations = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    regions = t("region").select("r_regionkey", "r_name")
    placed = orders.select(chunk("o_orderkey").alias("chunk_id"), name("order", "o_orderkey").alias("s"), F.lit("placed by").alias("p"), name("customer", "o_custkey").alias("o"))
    lives = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    lives1 = lives.select(chunk("o_orderkey"), name("customer", "o_custkey"), F.lit("in nation"), "n_name")
    lives2 = lives.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(chunk("o_orderkey"), "n_name", F.lit("in region"), "r_name")
    supplied = lines.select(chunk("k"), name("part", "l_partkey"), F.lit("supplied by"), name("supplier", "l_suppkey"))
    return placed.union(lives1).union(lives2).union(supplied)


TRIPLES = """triples AS (
  SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)) AS chunk_id, 'order ' || o_orderkey AS s, 'placed by' AS p, 'customer ' || o_custkey AS o FROM orders
  UNION ALL SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)), 'customer ' || o_custkey, 'in nation', n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)), n_name, 'in region', r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'chunk-' || md5(CAST(l_orderkey AS VARCHAR)), 'part ' || l_partkey, 'supplied by', 'supplier ' || l_suppkey FROM lineitem)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, s, p, o): a smaller graph of customers and suppliers as chunks that state where they are and for whom they buy."""
    t = lambda name: table(spark, sf_dir, name)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    chunk = lambda name: F.concat(F.lit("chunk-"), F.md5(name.cast("binary"))).alias("chunk_id")
    who, whom = F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string"))
    lives = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    facts = F.array(*(F.struct(a.alias("s"), F.lit(b).alias("p"), F.col(c).alias("o")) for a, b, c in ((who, "in nation", "n_name"), (F.col("n_name"), "in region", "r_name"), (who, "buys for", "c_mktsegment"))))
    sells = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return lives.select(chunk(who), F.inline(facts)).union(sells.select(chunk(whom), whom, F.lit("in nation"), "n_name"))


PLACES = """ns AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
places AS MATERIALIZED (SELECT 'chunk-' || md5('customer ' || c_custkey) AS chunk_id, unnest([struct_pack(s := 'customer ' || c_custkey, p := 'in nation', o := n_name), struct_pack(s := n_name, p := 'in region', o := r_name), struct_pack(s := 'customer ' || c_custkey, p := 'buys for', o := c_mktsegment)], recursive := true)
  FROM customer JOIN ns ON c_nationkey = n_nationkey
  UNION ALL SELECT 'chunk-' || md5('supplier ' || s_suppkey), 'supplier ' || s_suppkey, 'in nation', n_name FROM supplier JOIN ns ON s_nationkey = n_nationkey)"""


def with_vectors(spark: SparkSession, sf_dir: str, names: DataFrame, name: str) -> DataFrame:
    """names with a vector each: the one whose number a hash of the name gives."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("v_"), F.col("embedding").alias("vec"))
    n = vectors.agg(F.max("v_") + 1).first()[0] or 1
    at = F.conv(F.substring(F.md5(F.col(name).cast("binary")), 1, 8), 16, 10).cast("long") % n
    return names.withColumn("v_", at).join(vectors, "v_").drop("v_")


def vector_of(name: str) -> str:
    """The number of a name's vector, in SQL."""
    return f"CAST('0x' || substr(md5({name}), 1, 8) AS BIGINT) % (SELECT max(vec_id) + 1 FROM embeddings)"


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("qlabel"))


#: Two rankings per query, by cosine and by mass-warped cosine, with gold by label.
DOT = "list_inner_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
PAIRS = f"""q AS (SELECT vec_id AS qid, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT q.qid, q.qlabel, v.vec_id, v.label, {DOT.format("q.qvec", "v.embedding")} / sqrt({DOT.format("q.qvec", "q.qvec")} * {DOT.format("v.embedding", "v.embedding")}) AS cos FROM q, embeddings v WHERE v.vec_id <> q.qid)"""
