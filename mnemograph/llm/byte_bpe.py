"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens lie end to end in a doubly linked list of parts. Each adjacent pair
with a rank stands in that rank's bucket of list positions; a two-level bitmap
tells which buckets hold something, and find-first-set gives the lowest. A
position whose pair has changed meanwhile is stale and skipped. The work is near
linear in the length, so very long pieces without spaces are no special case, and
many short ones share one queue.

Defined results: a null text counts as empty (no ids, no bytes); repeated rows
are encoded each. Pairs of one rank merge from the left. Special strings are
ordinary text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemograph.llm.common import byte_texts, resident, unused
from mnemograph.llm.pretokens import PARTS, PartCache, grouped, read_ranks, splitter

#: Rows whose ids are held at once.
ROWS = 1000
#: Ranks that one leaf of the bitmap stands for, as a power of two.
LEAF_BITS = 9
LEAF_MASK = (1 << LEAF_BITS) - 1


class Vocabulary:
    """Ranks by token bytes, tokens by rank, and the ranks of all pairs of bytes as one array (-1: none)."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        self.pairs = np.full(1 << 16, -1)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank


def merge(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of each pre-token, as little-endian 32-bit integers.

    All lie end to end in one linked list; border tells where a piece begins, and no
    pair reaches over one, so that a bucket serves all pieces. The rank queue:
    buckets (list positions by rank), leaves (bitmaps of 2^LEAF_BITS ranks each) and
    top (the bitmap of leaves in use). now has the rank of the pair that begins at a
    position, so that an entry with another rank is known as stale.
    """
    ranks = vocabulary.ranks
    out = [ranks[p].to_bytes(4, "little") if p in ranks else b"" for p in pieces]
    rest = [k for k, ids in enumerate(out) if not ids and pieces[k]]
    if not rest:
        return out
    data = b"".join([pieces[k] for k in rest])
    n = len(data)
    starts = np.cumsum([0, *(len(pieces[k]) for k in rest)])
    border = bytearray(n + 1)
    for s in starts.tolist():
        border[s] = 1
    codes = np.frombuffer(data, np.uint8)
    ids = vocabulary.bytes[codes].tolist()
    first = vocabulary.pairs[(codes[:-1].astype(np.int64) << 8) | codes[1:]]
    first[starts[1:-1] - 1] = -1
    now = [*first.tolist(), -1]
    ends = list(range(1, n + 1))  # end of the part that starts here; its neighbour to the right starts there
    before = list(range(-1, n))
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    known, at = np.unique(first[order], return_index=True)
    buckets = dict(zip(known.tolist(), (part.tolist() for part in np.split(order, at[1:])))) if len(order) else {}
    leaves, top = [0] * ((len(vocabulary.tokens) >> LEAF_BITS) + 1), 0
    for rank in buckets:
        leaves[rank >> LEAF_BITS] |= 1 << (rank & LEAF_MASK)
        top |= 1 << (rank >> LEAF_BITS)
    rank_of = ranks.get
    while top:
        high = (top & -top).bit_length() - 1
        leaf = leaves[high]
        rank = (high << LEAF_BITS) + (leaf & -leaf).bit_length() - 1
        leaves[high] = leaf = leaf & (leaf - 1)
        if not leaf:
            top &= top - 1
        places = buckets.pop(rank)
        places.sort()
        for done, i in enumerate(places, 1):
            if now[i] != rank:
                continue  # stale
            middle = ends[i]
            ends[i] = end = ends[middle]
            ids[i] = rank
            now[middle] = -1
            lower = False
            if border[end]:
                now[i] = -1
            else:
                before[end] = i
                now[i] = new = rank_of(data[i : ends[end]], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        high = new >> LEAF_BITS
                        leaves[high] |= 1 << (new & LEAF_MASK)
                        top |= 1 << high
                    lower = new < rank
            if not border[i]:
                left = before[i]
                now[left] = new = rank_of(data[left:end], -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        buckets[new] = [left]
                        high = new >> LEAF_BITS
                        leaves[high] |= 1 << (new & LEAF_MASK)
                        top |= 1 << high
                    lower = lower or new < rank
            if lower and done < len(places):  # that pair goes first; the others wait in their bucket
                buckets[rank] = places[done:]
                leaves[rank >> LEAF_BITS] |= 1 << (rank & LEAF_MASK)
                top |= 1 << (rank >> LEAF_BITS)
                break
    flat, cuts, i = [], [0], 0
    for stop in starts[1:].tolist():
        while i < stop:
            flat.append(ids[i])
            i = ends[i]
        cuts.append(4 * len(flat))
    packed = np.array(flat, "<i4").tobytes()
    for k, a, b in zip(rest, cuts, cuts[1:]):
        out[k] = packed[a:b]
    return out


class Codec:
    """Encoder and decoder of one vocabulary, with a bounded cache."""

    def __init__(self, path: str, size: int = PARTS):
        self.vocabulary = Vocabulary(path)
        self.tokens = self.vocabulary.tokens
        self.cache = PartCache(splitter(), lambda keys: merge([k.encode() for k in keys], self.vocabulary), b"".join, size)

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for group in grouped(texts):
            for values in self.cache.of_all(group):
                yield np.frombuffer(b"".join(values), "<i4")

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec_of(path: str, size: int = PARTS) -> Codec:
    """One per Python worker, so that its cache outlives a task."""
    return resident(("byte-bpe", path, size), lambda: Codec(path, size))


def strings(column: pa.Array) -> Iterator[str]:
    """The texts; null counts as empty."""
    return (t.decode() if t else "" for t in byte_texts(column))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", cache: int = PARTS) -> tuple[DataFrame, str]:
    """docs with an array column of token ids; also returns that column's name. cache: text parts that a worker remembers."""
    name = unused(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path, cache)
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                got = list(codec.encode_all(strings(batch.column(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.int32()))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])), name


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> tuple[DataFrame, str]:
    """docs with a binary column of what the ids stand for; also returns that column's name. Null ids: null."""
    name = unused(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            got = [None if x is None else codec.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])), name


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each text, decodes the ids, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        numbers = [str(n) for n in range(len(codec.tokens))]
        for batch in batches:
            count, hashed, back = [], [], []
            for ids in map(np.ndarray.tolist, codec.encode_all(strings(batch.column("text")))):
                count.append(len(ids))
                hashed.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
