"""Fill-in-the-middle texts, assembled by a secondary sort.

A text is cut in two places that depend on its id alone into prefix, middle and
suffix, and these change places behind marks. No task builds an output: each text
gives pieces of at most UNITS code points, keyed by document and by their position
in the output; pieces are dealt by document and sorted by position within the
partitions, one shuffle of the text, and the sorted stream goes piece by piece into
digests. For the way back the same tasks cut the stream at its marks, key each piece
by its part of the text and sort again; the documents stay in their partitions, so
that needs no second shuffle. (The DataFrame form of repartitionAndSortWithinPartitions:
the JVM sorts and spills, no row is pickled.)

Defined results: a null text counts as empty and is plain; a null id counts as empty
text in the draw; texts that hold a mark are plain; equal rows are kept each. A row's
key is its place in its partition, so docs must give the same partitions when read
again, as tables do. Very long texts stream through in pieces. No rows, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from mnemograph.llm.common import byte_texts

#: Marks before prefix, suffix and middle; fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred transformed ones so many have the suffix first; fixed values.
RATE, SUFFIX_FIRST = 90, 20
#: Code points of a piece at most.
UNITS = 8192

#: What a document's first piece and its results say of it.
HEAD = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
#: Bytes of pieces after which a task gives a batch.
BATCH_BYTES = 1 << 24
#: The marks of a form in order with the part of the text that each begins: 0 prefix, 1 middle, 2 suffix.
LAYOUT = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": ()}


def drawn(doc_id: object, text: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text, by the hash of its id."""
    hashed = hashlib.sha256(b"1:" + ("" if doc_id is None else str(doc_id)).encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < suffix_first else "psm", a, b


def text_pieces(text: str, form: str, a: int, b: int, units: int = UNITS) -> Iterator[tuple[int, bytes]]:
    """(position in the output, piece), in the order of the text."""
    bounds = ((0, a), (a, b), (b, len(text)))
    starts, at = {}, 0
    for mark, part in LAYOUT[form]:
        starts[part] = at, mark
        at += len(mark) + bounds[part][1] - bounds[part][0]
    for part, (low, high) in enumerate(bounds) if starts else [(0, (0, len(text)))]:
        at, mark = starts.get(part, (0, ""))
        first = min(high, low + max(units - len(mark), 1))
        yield at, (mark + text[low:first]).encode()
        for k in range(first, high, units):
            yield at + len(mark) + k - low, text[k : min(k + units, high)].encode()


def packed(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema)], schema.names)


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", units: int = UNITS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(row, place, id, n, form, prefix_chars, middle_chars, piece): the outputs' pieces, each document's in one partition and in order.

    Only a document's first piece, place 0, has its id and what follows it.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("place", T.LongType()), T.StructField("id", docs.schema[doc_id].dataType), *HEAD, T.StructField("piece", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, out, held = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for ident, t in zip(batch.column(doc_id).to_pylist(), byte_texts(batch.column(text))):
                whole = t.decode() if t else ""
                form, a, b = drawn(ident, whole, rate, suffix_first)
                first = (ident, len(whole), form, *((None, None) if form == "plain" else (a, b - a)))
                for place, piece in text_pieces(whole, form, a, b, units):
                    out.append((row, place, *(first if place == 0 else (None,) * 5), piece))
                    held += len(piece)
                row += 1
                if held > BATCH_BYTES:
                    yield packed(out, schema)
                    out, held = [], 0
        yield packed(out, schema)

    return docs.select(doc_id, text).mapInArrow(run, schema).repartition("row").sortWithinPartitions("row", "place")


class Parts:
    """An output cut at its marks as its pieces come: (part, piece) of the text. A mark may lie across pieces."""

    def __init__(self, form: str):
        self.coming, self.part, self.held = list(LAYOUT[form]), 0, b""

    def push(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        held = self.held + piece
        while self.coming:
            mark, part = self.coming[0]
            at = held.find(mark.encode())
            if at < 0:
                break
            yield self.part, held[:at]
            held, self.part = held[at + len(mark) :], part
            del self.coming[0]
        ready = max(len(held) - len(MIDDLE) + 1, 0) if self.coming else len(held)
        yield self.part, held[:ready]
        self.held = held[ready:]


def restored_pieces(output: DataFrame) -> DataFrame:
    """(row, part, place, id, n, form, prefix_chars, middle_chars, output_sha256, piece): the texts' pieces, made from those of the outputs and in order.

    A document's first row, part -1, has its id, its form and the digest of its output.
    """
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), output.schema["id"], *HEAD, T.StructField("output_sha256", T.StringType()), T.StructField("piece", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, head, digest, parts, order = None, (), hashlib.sha256(), Parts("plain"), 0
        for batch in batches:
            out = []
            for r, place, *first, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if r != row:
                    if row is not None:
                        out.append((row, -1, 0, *head, digest.hexdigest(), None))
                    row, head, digest, parts, order = r, first, hashlib.sha256(), Parts(first[2]), 0
                digest.update(piece)
                for part, own in parts.push(piece):
                    if own:
                        out.append((row, part, order, *(None,) * 6, own))
                        order += 1
            yield packed(out, schema)
        if row is not None:
            yield packed([(row, -1, 0, *head, digest.hexdigest(), None)], schema)

    return output.mapInArrow(run, schema).sortWithinPartitions("row", "part", "place")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row."""
    restored = restored_pieces(pieces(docs, doc_id, text, **options))
    schema = T.StructType([docs.schema[doc_id], *HEAD, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for part, piece, *first in zip(*(batch.column(c).to_pylist() for c in ("part", "piece", "id", *(f.name for f in HEAD), "output_sha256"))):
                if part >= 0:
                    digest.update(piece)
                    continue
                if head:
                    out.append((*head, digest.hexdigest()))
                head, digest = first, hashlib.sha256()
            yield packed(out, schema)
        if head:
            yield packed([(*head, digest.hexdigest())], schema)

    return restored.mapInArrow(run, schema)


def outputs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the whole transformed texts."""
    schema = T.StructType([docs.schema[doc_id], *HEAD, T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            out = []
            for _, place, *first, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 0 and head:
                    out.append((*head, b"".join(held).decode()))
                if place == 0:
                    head, held = first, []
                held.append(piece)
            yield packed(out, schema)
        if head:
            yield packed([(*head, b"".join(held).decode())], schema)

    return pieces(docs, doc_id, text, **options).mapInArrow(run, schema)
