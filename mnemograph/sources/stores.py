"""Tables as stores: insert what is absent, upsert, look up, delete; shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.functions import text

STORE = T.StructType([T.StructField("hash_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CONVERSATIONS = T.StructType(STORE.fields[:2])


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir; one is set only where it is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-mnemograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back; ids are often hex, which zstd halves."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed(texts: DataFrame, column: str, prefix: str) -> DataFrame:
    """Distinct (hash_id, content) of non-null texts."""
    t = texts.where(F.col(column).isNotNull())
    return t.select(text.hash_id(F.col(column), prefix).alias("hash_id"), F.col(column).alias("content")).dropDuplicates(["hash_id"])


def absent(incoming: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of incoming whose key the store lacks; equal keys collapse."""
    return incoming.dropDuplicates([key]).join(store.select(key), key, "left_anti")


def insert(incoming: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.unionByName(absent(incoming, store, key), allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last version of each key wins; on equal versions the new row."""
    both = old.withColumn("is_new_", F.lit(0)).unionByName(new.withColumn("is_new_", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc(version), F.desc("is_new_"))
    return both.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_", "is_new_")


def lookup(keys: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    return keys.join(store, key)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def get(store: DataFrame, keys: DataFrame | None = None, where: Column | None = None, key: str = "hash_id") -> DataFrame:
    """The store's rows with one of the keys that meet a condition; either may be left out."""
    found = store if keys is None else store.join(keys.select(key).distinct(), key, "left_semi")
    return found if where is None else found.where(where)


def ingest(chunks: DataFrame, stores: dict[str, DataFrame], column: str = "text", prefix: str = "chunk-") -> tuple[dict[str, DataFrame], DataFrame]:
    """The same chunks put into each store if absent: the new stores, and (store, stored, added) of each."""
    new = kept(hashed(chunks, column, prefix), "incoming")
    after = {name: insert(new, old) for name, old in stores.items()}
    counts = [rows.agg(F.lit(name).alias("store"), F.count("*").alias("stored")).join(absent(new, stores[name]).agg(F.count("*").alias("added")), F.lit(True)) for name, rows in after.items()]  # one row each
    whole = counts[0]
    for c in counts[1:]:
        whole = whole.union(c)
    return after, whole


def write_records(records: DataFrame, path: str, kind: str = "json") -> None:
    """A result sink: nested records, one a row, as JSON lines or Parquet."""
    getattr(records.write.mode("overwrite"), kind)(path)


def members(mapping: DataFrame, group: str, member: str) -> DataFrame:
    """(group, member, n): each member of a group as a row, with the group's size."""
    sizes = mapping.groupBy(group).agg(F.count("*").alias("n"))
    return mapping.select(group, member).join(sizes, group)


def not_extracted(chunks: DataFrame, results: DataFrame, key: str = "idx") -> DataFrame:
    """Chunks that the extraction results don't have yet."""
    return chunks.join(results.select(key), key, "left_anti")


def extraction_stats(results: DataFrame, entities: str = "extracted_entities") -> DataFrame:
    """One row: entities, and their mean characters and words."""
    e = results.select(F.explode(entities).alias("e"))
    return e.agg(F.count("*").alias("entities"), F.avg(F.length("e")).alias("avg_ent_chars"), F.avg(F.size(F.split("e", " "))).alias("avg_ent_words"))


def patched(rows: DataFrame, fixes: DataFrame, key: str, value: str) -> DataFrame:
    """Values of fixes replace those of rows with the same key."""
    f = fixes.dropDuplicates([key]).select(key, F.col(value).alias("fix_"))
    return rows.join(f, key, "left").withColumn(value, F.coalesce("fix_", value)).drop("fix_")


def first_filled(*columns: str) -> Column:
    """The first column that isn't null or blank."""
    return F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from lines with any of the known field names; blank lines and rows without text dropped."""
    fields = ("input", "text", "content", "chunk_text", "chunk_id", "id")
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("n", F.monotonically_increasing_id())
    d = lines.select("n", F.from_json("value", schema).alias("j")).select("n", "j.*")
    return d.select(F.coalesce(first_filled("chunk_id", "id"), F.concat(F.lit("chunk_"), F.col("n").cast("string"))).alias("id"), first_filled("input", "text", "content", "chunk_text").alias("text")).where("text IS NOT NULL")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_arrays(rows: DataFrame, path: str) -> None:
    """rows as files of one JSON array each, a record a line."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            lines = batch.column("j").to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([mark + lines[0], *("," + x for x in lines[1:])])], ["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).mapInArrow(run, "value string").write.text(path)


def any_text(b: bytes) -> str:
    """Decoded by the first charset that fits."""
    for charset in ("utf-8", "gbk", "gb2312", "latin-1", "cp1252"):
        try:
            return b.decode(charset)
        except UnicodeDecodeError:
            continue
    return b.decode("utf-8", "ignore")


def decoded_rows(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, text) of each row's bytes, decoded on their own."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if b is None else any_text(b) for b in batch.column(content).to_pylist()], pa.string())], [key, "text"])

    return rows.select(key, content).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def read_any_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, decoded by the first charset that fits: utf-8, gbk, gb2312, latin-1."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([any_text(b) for b in batch.column("content").to_pylist()], pa.string())], ["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string")


def run_log(lines: DataFrame) -> DataFrame:
    """(file, epoch, metric, number) from log lines (file, n, value); a metric belongs to the last epoch line before it.

    Lines are sorted into ranges of (file, n), however many files there are. Within a range
    the last epoch is carried on; what a range begins with comes from the ranges before, of
    which there is one row for each range and file.
    """
    epoch = F.regexp_extract("value", r"Epoch (\d+)/\d+", 1)
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = lines.select("file", "n", "value", F.when(epoch != "", epoch.cast("int")).alias("own"))
    d = kept(d.repartitionByRange(parts, "file", "n").withColumn("range_", F.spark_partition_id()), "log-ranges")
    so_far = Window.partitionBy("file", "range_").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("seen", F.last("own", ignorenulls=True).over(so_far))
    last = d.groupBy("file", "range_").agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("n"))).alias("last"))
    before = Window.partitionBy("file").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of the file
    carried = last.select("file", "range_", F.last("last", ignorenulls=True).over(before).alias("carried"))
    d = d.withColumn("metric", F.regexp_extract("value", r"(Train Loss|Val Loss|Avg Kappa): ", 1)).withColumn("number", F.regexp_extract("value", r"(?:Train Loss|Val Loss|Avg Kappa): ([0-9.]+)", 1))
    d = d.where("metric != ''").join(carried, ["file", "range_"])
    return d.select("file", F.coalesce("seen", "carried").alias("epoch"), "metric", F.col("number").cast("double").alias("number"))


def metadata_json(metadata: Column) -> Column:
    return F.to_json(metadata)
