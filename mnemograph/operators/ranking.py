"""Normalising and ranking scores within each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per(*keys: str):
    return Window.partitionBy(*keys)


def fresh(key: str) -> Column:
    """A numeric key as a computed column: Spark 4.1 may pair unequal partitions where a union's sides share a partitioning by key."""
    return (F.col(key) + F.lit(0).cast("long")).alias(key)


def best_first(score: str = "score", ident: str = "id", key: str = "qid"):
    return Window.partitionBy(key).orderBy(F.desc(score), F.asc(ident))


def min_max(score: str = "score", key: str = "qid") -> Column:
    """1 for all rows of a query whose scores are equal."""
    w = per(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(F.lit(1.0))


def min_max_eps(score: str = "score", key: str = "qid", eps: float = 1e-6) -> Column:
    w = per(key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (F.col(score) - low) / (high - low + eps)


def z_score(score: str = "score", key: str = "qid") -> Column:
    w = per(key)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd > 0, (F.col(score) - F.avg(score).over(w)) / sd).otherwise(F.lit(0.0))


def l2(score: str = "score", key: str = "qid") -> Column:
    size = F.sqrt(F.sum(F.col(score) * F.col(score)).over(per(key)))
    return F.when(size > 0, F.col(score) / size).otherwise(F.lit(0.0))


def ranked(df: DataFrame, score: str = "score", ident: str = "id", key: str = "qid", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(best_first(score, ident, key)).cast("long"))


def top_k(df: DataFrame, k: int, score: str = "score", ident: str = "id", key: str = "qid") -> DataFrame:
    """Spark turns the filtered row number into a group limit before the shuffle."""
    return ranked(df, score, ident, key).where(F.col("rank") <= k)


#: Rows that a task sorts at once to keep each query's best.
SORTED = 500_000


def best_in_tasks(df: DataFrame, k: int, score: str = "score", ident: str = "id", key: str = "qid", size: int = SORTED) -> DataFrame:
    """top_k where rows are many and queries few: each task keeps k rows a query as its rows come, and only those are shuffled and sorted by Spark."""

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(key, "ascending"), (score, "descending"), (ident, "ascending")]))
        code = np.asarray(rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices)
        return rows.filter(pa.array(np.arange(len(code)) - np.searchsorted(code, code) < k))  # codes ascend by first place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size + 2 * kept:
                table = best(pa.Table.from_batches(held))
                held, n, kept = table.to_batches(), table.num_rows, table.num_rows
        if n:
            yield from best(pa.Table.from_batches(held)).to_batches()

    return top_k(df.mapInArrow(run, df.schema), k, score, ident, key)


def position_weight(score: str = "score", ident: str = "id", key: str = "qid") -> Column:
    """Number of the query's rows less the row's place, from 0."""
    return F.count("*").over(per(key)) - F.row_number().over(best_first(score, ident, key)) + 1


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """df with each row's place from 0 in the given order, without holes: sorted ranges, each counted, numbered from the sum of those before."""
    from mnemograph.sources import stores

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = stores.kept(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    sizes = d.groupBy("range_").agg(F.count("*").alias("size_"))
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = sizes.select("range_", F.coalesce(F.sum("size_").over(before), F.lit(0)).alias("base_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return d.join(F.broadcast(bases), "range_").withColumn(name, F.col("base_") + within - 1).drop("range_", "base_")


def first_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows in the given order, however large k is, without one task that holds them all."""
    return numbered(df, *order, name="place_").where(F.col("place_") < k).drop("place_")
