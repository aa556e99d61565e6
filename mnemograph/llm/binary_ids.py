"""Token ids as flat binary files with 64-bit document offsets.

A shard is a pair of files: NAME.bin holds the ids of its documents end to end
as little-endian unsigned integers (16 bits where the vocabulary allows it, else
32), NAME.idx a header of four 64-bit numbers (magic, version, bytes per id,
documents), then documents + 1 offsets in ids, each 64 bits, NAME.ids the document
ids of any type as an Arrow file. Documents are range
partitioned by id, so shard after shard they come in ascending doc_id order.
Each task writes under a name of its own and reports it as a row; the rows are
saved with Spark's commit protocol, so what a lost or repeated attempt left
behind is never read. The shards' bases are prefix sums over those rows, one per
shard.

Defined results: a null text counts as empty (the end id only); null doc_ids come
first; rows with one doc_id, ties and repeated rows too, are kept each and ordered
by their text's hash. No rows, no shards with documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import byte_texts, opened, resident, scratch, stored
from mnemograph.llm.pretokens import TwoHalves

MAGIC, VERSION = 0x4D474944, 1
END = 1


#: Chunks in either half of the cache.
CHUNKS = 600_000


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, each distinct white-space-free chunk encoded once.

    The vocabulary's rules (composition, lower case, removed white space, word
    pattern, special strings) never reach over ASCII white space, so a text's ids
    are its chunks' ids in order. ASCII letters are folded first, as the rules do
    later, unless a combining mark might compose with one case only or a special
    string might arise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = TwoHalves(self._fill, CHUNKS)

    def _fill(self, chunks: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(self.cache.of(text.split()))


def encoder_of(path: str) -> ChunkEncoder:
    """One per Python worker, so that its cache outlives a task."""
    return resident(("token-ids", path), lambda: ChunkEncoder(path))


def id_bytes(tokenizer: str, end: int | None) -> int:
    """Bytes that an id of the vocabulary, or the end id, takes: 2 or 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end or 0) < 1 << 16 else 4


def write(docs: DataFrame, tokenizer: str, folder: str, end: int | None = END, width: int | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards of docs(doc_id, text) into folder; return their manifest (shard, name, docs, ids, base, base_docs).

    width: bytes of an id; as many as the vocabulary needs if None.
    """
    width = width or id_bytes(tokenizer, end)
    spark = docs.sparkSession
    number = shards or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", "text").repartitionByRange(number, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    kind = "<u2" if width == 2 else "<u4"
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = encoder_of(tokenizer), TaskContext.get()
        name = f"{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        store, path = opened(folder)
        store.create_dir(path, recursive=True)
        at, offsets, ids = 0, [0], []  # the ids are one 64-bit number or short text a document
        with store.open_output_stream(f"{path}/{name}.bin") as out:
            for batch in batches:
                ids.append(batch.select(["doc_id"]))
                for text in byte_texts(batch.column("text")):
                    found = encoder.encode(text) + tail
                    at += len(found) // 4
                    offsets.append(at)
                    out.write(np.frombuffer(found, "<u4").astype(kind).tobytes() if width == 2 else found)
        with store.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.array([MAGIC, VERSION, width, len(offsets) - 1], "<u8").tobytes())
            out.write(np.array(offsets, "<u8").tobytes())
        if ids:
            with store.open_output_stream(f"{path}/{name}.ids") as out, pa.ipc.new_file(out, ids[0].schema) as file:
                for part in ids:
                    file.write_batch(part)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name], pa.string()), pa.array([len(offsets) - 1], pa.int64()), pa.array([at], pa.int64())], ["shard", "name", "docs", "ids"])

    rows = stored(ordered.mapInArrow(run, "shard int, name string, docs long, ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return rows.select("*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("base_docs"))


def mapped(uri: str, kind: str) -> np.ndarray:
    """A shard file as an array: memory-mapped where it is a local or mounted file, else read."""
    store, path = opened(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def document_ids(uri: str) -> pa.ChunkedArray:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all().column("doc_id")


def read(manifest: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. kind: the type of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["docs"]:
                    continue
                head = mapped(f"{folder}/{row['name']}.idx", "<u8")
                if (int(head[0]), int(head[1]), int(head[3])) != (MAGIC, VERSION, row["docs"]):
                    raise ValueError(f"not a shard: {row['name']}")
                offsets, width = head[4:].astype(np.int64), int(head[2])
                ids, docs = mapped(f"{folder}/{row['name']}.bin", f"<u{width}"), document_ids(f"{folder}/{row['name']}.ids")
                for a in range(0, row["docs"], 4096):
                    b = min(a + 4096, row["docs"])
                    sums = [zlib.crc32(ids[offsets[i] : offsets[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs.slice(a, b - a).chunks), pa.array(offsets[a:b] + row["base"], pa.int64()), pa.array(np.diff(offsets[a : b + 1]), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    number = max(1, manifest.count())
    return manifest.repartition(number, "shard").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    folder = scratch(docs.sparkSession, "token-ids")
    return read(write(docs, tokenizer, folder, end), folder, docs.schema["doc_id"].dataType.simpleString())
