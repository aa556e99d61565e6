"""Vector search: a table of queries against all keys exactly, in one plan, or against an inverted file.

The queries are written to the shared folder as files of at most BLOCK rows. Each
task holds one slab of its keys at a time and goes through the files, with matrix
products, so the plan has one pass over the keys whatever the number of queries,
nothing goes through the driver and nothing is broadcast. Keys are never shuffled;
per query and slab only k rows, or the pairs over a threshold, leave a task.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.sources import stores

#: Queries of a file; keys a task holds; keys of one matrix product.
BLOCK, SLAB, STEP = 4096, 65_536, 1024
#: Pairs beyond its k best a query that a task holds before it cuts them again.
HELD = 2_000_000


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def blocks(rows: DataFrame, size: int = BLOCK) -> str:
    """rows written as files of at most `size` rows; the folder's path."""
    path = stores.shared_path(rows.sparkSession, "blocks")
    rows.write.option("maxRecordsPerFile", size).parquet(path)
    return path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))


def read_block(path: str) -> pa.Table:
    """One file, in a task."""
    store, name = opened(path)
    with store.open_input_file(name) as source:
        return pq.ParquetFile(source).read()


def read_blocks(path: str, wanted: Callable[[pq.FileMetaData], bool] = lambda _: True, columns: list[str] | None = None) -> Iterator[pa.Table]:
    """The files of a folder one by one, in a task."""
    store, root = opened(path)
    for name in sorted(f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet")):
        with store.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            if file.metadata.num_rows and wanted(file.metadata):
                yield file.read(columns)


def slabs(batches: Iterator[pa.RecordBatch], size: int = SLAB) -> Iterator[pa.Table]:
    """A task's rows in tables of about `size` rows."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def best_of(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties to the lesser id."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]


def id_schema(queries: DataFrame, keys: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", keys.schema["id"].dataType), T.StructField("score", T.DoubleType())])


def values(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as an array that can be compared and sorted."""
    return np.array(column.to_pylist())


def rows_of(qid: pa.ChunkedArray, i: np.ndarray, ids: pa.ChunkedArray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    taken = [pa.chunked_array([c.take(pa.array(at))]) if isinstance(c, pa.Array) else c.take(pa.array(at)) for c, at in ((qid, i), (ids, j))]
    return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in taken), pa.array(score, pa.float64())], ["qid", "id", "score"])


def search(queries: DataFrame, keys: DataFrame, k: int | None = None, least: float | None = None, metric: str = "cosine", block: int = BLOCK, slab: int = SLAB, beta: float = 10.0, itself: bool = False) -> DataFrame:
    """(qid, id, score): per query the k best keys other than itself, or all that score `least` or more, or the k best of those.

    queries(qid, qvec), keys(id, vec); ids of any type. Where both have one type, a key with
    the query's id is the query itself and left out, unless `itself`. metric: cosine, dot, or warped, which is
    -(1 - cosine) / (1 + beta * mass) for keys(id, vec, mass). Null vectors are
    skipped; a zero vector has cosine 0 with all. Ties go to the lesser id.
    """
    schema = id_schema(queries, keys)
    same = not itself and schema["qid"].dataType == schema["id"].dataType
    keys = keys.select("id", "vec", *(["mass"] if metric == "warped" else [])).where("vec IS NOT NULL")
    cosine, path = metric != "dot", blocks(queries.select("qid", "qvec").where("qvec IS NOT NULL"), block)

    def pairs(qid: np.ndarray, q: np.ndarray, key: np.ndarray, m: np.ndarray, mass: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(row of q, row of m, score) of what may be in the result."""
        found = []

        def cut(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            i, j, score = (np.concatenate(x) for x in zip(*found))
            on = slice(None) if k is None else best_of(i, key[j], score, k)
            return i[on], j[on], score[on]

        for a in range(0, len(key), STEP):
            scores = q @ m[a : a + STEP].T
            if mass is not None:
                scores = (scores - 1) / (1 + beta * mass[a : a + STEP])
            if least is not None:
                bound = least
            else:  # one more than k, as the query itself may be among them
                bound = np.partition(scores, -k - 1, axis=1)[:, -k - 1 :][:, :1] if scores.shape[1] > k + 1 else -np.inf
            i, j = np.nonzero(scores >= bound)
            if same:
                on = qid[i] != key[a + j]
                i, j = i[on], j[on]
            found.append((i, a + j, scores[i, j]))
            if k is not None and sum(len(x[0]) for x in found) > HELD + k * len(q):
                found = [cut(found)]
        return cut(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slabs(batches, slab):
            key, m = values(held.column("id")), matrix(held.column("vec"))
            m = unit_rows(m) if cosine else m
            mass = np.asarray(held.column("mass"), np.float64) if metric == "warped" else None
            for table in read_blocks(path):
                qid, q = values(table.column("qid")), matrix(table.column("qvec"))
                q = unit_rows(q) if cosine else q
                for a in range(0, len(key), STEP if k is None else len(key)):  # pairs over a threshold leave by parts, as there is no bound on their number
                    part = slice(a, a + STEP if k is None else None)
                    i, j, score = pairs(qid, q, key[part], m[part], None if mass is None else mass[part])
                    yield rows_of(table.column("qid"), i, held.column("id"), a + j, score)

    found = keys.mapInArrow(run, schema)
    if k is None:
        return found
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("r_", F.row_number().over(best)).where(F.col("r_") <= k).drop("r_")


def sums(queries: DataFrame, keys: DataFrame, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """(qid, node, sim): the sum of a query's positive cosines with all keys(id, vec, node) of a node other than itself.

    As search(), but the pairs are added up where they are made: per query, node and STEP
    keys of a slab at most one row leaves a task. A node without a positive cosine has no row.
    """
    kinds = id_schema(queries, keys)
    schema = T.StructType([kinds["qid"], T.StructField("node", keys.schema["node"].dataType), T.StructField("sim", T.DoubleType())])
    same = kinds["qid"].dataType == kinds["id"].dataType
    path = blocks(queries.select("qid", "qvec").where("qvec IS NOT NULL"), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in slabs(batches, slab):
            code = np.asarray(held.column("node").combine_chunks().dictionary_encode(null_encoding="encode").indices)
            order = np.argsort(code, kind="stable")
            held, code = held.take(pa.array(order)), code[order]
            key, m = values(held.column("id")), unit_rows(matrix(held.column("vec")))
            for table in read_blocks(path):
                qid, q = values(table.column("qid")), unit_rows(matrix(table.column("qvec")))
                for a in range(0, len(key), STEP):
                    scores = np.maximum(q @ m[a : a + STEP].T, 0)
                    if same:
                        scores[qid[:, None] == key[None, a : a + STEP]] = 0
                    starts = np.flatnonzero(np.diff(code[a : a + STEP], prepend=-1))
                    added = np.add.reduceat(scores, starts, axis=1)
                    i, j = np.nonzero(added)
                    out = rows_of(table.column("qid"), i, held.column("node"), a + starts[j], added[i, j])
                    yield pa.RecordBatch.from_arrays(out.columns, schema.names)

    found = keys.where("vec IS NOT NULL").select("id", "vec", "node").mapInArrow(run, schema)
    return found.groupBy("qid", "node").agg(F.sum("sim").alias("sim"))


#: Rows that an index is fitted on, at most about; vectors of a codebook; iterations over it.
SAMPLE, WORDS, ROUNDS = 20_000, 256, 12


class Index(NamedTuple):
    """An inverted file: keys in folders by list, each with the product-quantised residual from its list's centre.

    model: a folder with one array file of centres (lists, d) and codebooks (parts, WORDS, d / parts).
    """

    keys: DataFrame  # (id, vec, code, list), stored
    model: str
    lists: int


def nearest_rows(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.argmin((centres * centres).sum(1)[None, :] - 2 * m @ centres.T, axis=1)


def clustered(m: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centres = m[rng.choice(len(m), min(k, len(m)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest_rows(m, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, m)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def model_of(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Centres and codebooks, read by a task from the shared folder."""
    (table,) = read_blocks(folder)
    lists, dims, parts, words, centres, books = (table.column(c)[0].as_py() for c in ("lists", "dims", "parts", "words", "centres", "books"))
    return np.frombuffer(centres).reshape(lists, dims), np.frombuffer(books).reshape(parts, words, dims // parts)


def index(keys: DataFrame, lists: int = 64, parts: int = 16, sample: int = SAMPLE, seed: int = 7) -> Index:
    """An index of keys(id, vec) by cosine: fitted on a sample of at most about `sample` rows, every key listed.

    parts must divide the vectors' length.
    """
    spark, rows = keys.sparkSession, keys.where("vec IS NOT NULL").select("id", "vec")
    n = rows.count()
    rate = min(1.0, sample / max(n, 1))
    held = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.to_json(F.struct("id"))), F.lit(1 << 20)) < int(rate * (1 << 20))).select("vec").toPandas()["vec"]
    m = unit_rows(np.array(held.tolist(), np.float64)) if len(held) else np.zeros((1, parts))
    centres = clustered(m, lists, seed)
    rest = (m - centres[nearest_rows(m, centres)]).reshape(len(m), parts, -1)
    books = np.array([clustered(rest[:, p], WORDS, seed + p) for p in range(parts)])
    row = (len(centres), m.shape[1], parts, books.shape[1], centres.tobytes(), books.tobytes())
    model = stores.shared_path(spark, "index-model")
    spark.createDataFrame([row], "lists int, dims int, parts int, words int, centres binary, books binary").coalesce(1).write.parquet(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model_of(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = unit_rows(matrix(batch.column("vec")))
            own = nearest_rows(v, centres)
            rest = (v - centres[own]).reshape(len(v), len(books), -1)
            codes = np.stack([nearest_rows(rest[:, p], book) for p, book in enumerate(books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own, pa.int32())], ["id", "vec", "code", "list"])

    schema = T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), T.StructField("list", T.IntegerType())])
    path = stores.shared_path(spark, "index")
    rows.mapInArrow(run, schema).write.partitionBy("list").parquet(path)
    return Index(spark.read.schema(schema).parquet(path), model, len(centres))


def candidates(queries: DataFrame, made: Index, k: int, probes: int, refine: int, slab: int = SLAB) -> DataFrame:
    """(qid, id, score, scored): of each probed list a query's k best keys, and how many of its keys were scored exactly.

    A query is dealt to its nearest lists, and the folders of lists that nobody asks for
    aren't read. A task holds keys of one list after another and reads that list's
    queries; the codes of all its keys give rough scores, the best `refine` keys a query
    and slab are scored exactly.
    """
    schema = T.StructType([*id_schema(queries, made.keys), T.StructField("scored", T.LongType())])
    same, model = schema["qid"].dataType == schema["id"].dataType, made.model
    asked = queries.where("qvec IS NOT NULL").select("qid", "qvec")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, _ = model_of(model)
        for batch in batches:
            q = unit_rows(matrix(batch.column("qvec"))) if batch.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(len(q)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(near.ravel(), pa.int32())], ["qid", "qvec", "list"])

    path = stores.shared_path(queries.sparkSession, "probes")
    asked.mapInArrow(probe, T.StructType([*asked.schema.fields, T.StructField("list", T.IntegerType())])).write.option("maxRecordsPerFile", BLOCK).partitionBy("list").parquet(path)
    wanted = queries.sparkSession.read.parquet(path).select("list").distinct() if queries.limit(1).count() else None
    lists = [r[0] for r in wanted.collect()] if wanted is not None else []  # as many as there are lists at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = model_of(model)
        for held in slabs(batches, slab):
            own = np.asarray(held.column("list"))
            for n in np.unique(own):
                part = held.take(pa.array(np.flatnonzero(own == n)))
                key, m = values(part.column("id")), unit_rows(matrix(part.column("vec")))
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
                for table in read_blocks(f"{path}/list={n}"):
                    qid, q = values(table.column("qid")), unit_rows(matrix(table.column("qvec")))
                    rough = np.repeat((q @ centres[n])[:, None], len(key), axis=1)
                    for p, book in enumerate(books):
                        rough += (q.reshape(len(q), len(books), -1)[:, p] @ book.T)[:, codes[:, p]]
                    few = min(len(key), refine)
                    best = np.argpartition(-rough, few - 1, axis=1)[:, :few]
                    i, j = np.repeat(np.arange(len(q)), few), best.ravel()
                    if same:
                        on = qid[i] != key[j]
                        i, j = i[on], j[on]
                    score = np.einsum("ij,ij->i", q[i], m[j])
                    at = best_of(i, key[j], score, k)
                    out = rows_of(table.column("qid"), i[at], part.column("id"), j[at], score[at])
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array([few] * len(at), pa.int64())], schema.names)

    return made.keys.where(F.col("list").isin(lists)).mapInArrow(run, schema)


def approximate(queries: DataFrame, keys: DataFrame | Index, k: int, lists: int = 64, probes: int = 16, refine: int | None = None, **options) -> DataFrame:
    """(qid, id, score): like search() by cosine, but a query looks through its `probes` nearest lists of an index alone; scores are exact.

    Recall grows with the probes and with refine, the keys of a list that are scored exactly (2 k).
    """
    made = keys if isinstance(keys, Index) else index(keys, lists, **options)
    found = candidates(queries, made, k, probes, refine or 2 * k).drop("scored")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("r_", F.row_number().over(best)).where(F.col("r_") <= k).drop("r_")
