"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and every delimiter of the word rule to a space, for bytes.translate.
ASCII_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share.

    The session's spark.checkpoint.dir names it; only where that is unset and the
    master is local (tests) is a folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-mnemograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def table_files(path: str) -> list[str]:
    """Names of a stored table's files, for tasks that read them one by one."""
    store, root = opened(path)
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))


def table_file(path: str, name: str) -> pa.Table:
    with opened(path)[0].open_input_file(name) as source:
        return pq.read_table(source)


#: Rows of a small table up to which joined() broadcasts it.
BROADCAST_ROWS = 200_000


def joined(rows: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined to a table of a few narrow columns that has far fewer rows.

    That table is stored and counted first. Up to `bound` rows it is broadcast, so
    that rows stay where they are, however hot a key is; beyond, both sides are dealt
    by key and sorted, where Spark splits skewed keys.
    """
    few = stored(few, "few")
    small = few.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(few) if small else few.hint("merge"), on, how)


_kept: dict[tuple, Any] = {}


def resident(key: tuple, make: Callable[[], Any]) -> Any:
    """The one large object (tables, caches) that a Python worker keeps between tasks.

    Another operator's tasks in the same worker replace it, so that a pipeline's
    stages don't add up in memory.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed pages otherwise
        if trim:
            trim(0)
        _kept[key] = make()
    return _kept[key]


def unused(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def id_hash(col: str) -> Column:
    """crc32 of an id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()
