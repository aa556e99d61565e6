"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch of texts lie end to end in one array of
symbols. In each round every pre-token finds its lowest-rank adjacent pair and
merges all its occurrences at once, left to right; pre-tokens without a known
pair leave. The symbols that survive are the tokens. Applying all occurrences
of one pair in a round equals merging them one by one, since a merge only makes
pairs of later rank.

Defined results: a null text counts as empty (0 tokens); repeated rows are
counted each. The vocabulary's
special strings inside a text are one token each, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from mnemograph.llm.common import byte_texts, resident
from mnemograph.llm.pretokens import PARTS, PartCache, byte_alphabet, grouped, splitter

LIMIT = 512


class MergeTable:
    """Merges of a byte-level vocabulary file as sorted numpy keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_alphabet().items():
            self.first[byte] = vocab[letter]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.none = len(pairs)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)


def merge_counts(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """Number of tokens of each piece."""
    n = len(pieces)
    counts = np.zeros(n, np.int64)
    if not n:
        return counts
    sizes = np.fromiter(map(len, pieces), np.int64, n)
    symbols = table.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(n), sizes)
    rank = pair_ranks(symbols, owner, np.arange(len(symbols)), table)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.r_[starts, len(symbols)])
        done = best == table.none
        if done.any():
            counts[owner[starts[done]]] = lengths[done]
            stay = np.repeat(~done, lengths)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            best, lengths = best[~done], lengths[~done]
            if not len(symbols):
                break
        take = np.flatnonzero(rank == np.repeat(best, lengths))
        # runs of overlapping pairs, as in aaa: every second one, from the left
        if len(take) > 1 and (np.diff(take) == 1).any():
            begins = np.r_[True, np.diff(take) != 1]
            begin = np.maximum.accumulate(np.where(begins, np.arange(len(take)), 0))
            take = take[(np.arange(len(take)) - begin) % 2 == 0]
        symbols[take] = table.merged[rank[take]]
        keep = np.ones(len(symbols), bool)
        keep[take + 1] = False
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        at = take - np.arange(len(take))  # where the merged symbols are now
        changed = np.concatenate([at, at[at > 0] - 1])
        rank[changed] = pair_ranks(symbols, owner, changed, table)
    return counts


def pair_ranks(symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, table: MergeTable) -> np.ndarray:
    """Ranks of the pairs that begin at the given places; none at a piece's last symbol."""
    after = np.minimum(at + 1, len(symbols) - 1)
    return np.where((owner[after] == owner[at]) & (after > at), table.rank(symbols[at], symbols[after]), table.none)


def unknown(text: str) -> bool:
    """Whether text has characters that newer Unicode tables class otherwise than the library's."""
    return not text.isascii() and max(text) > "\u0557" and any(category(c) == "Cn" for c in set(text))


class Counter:
    """Numbers of tokens of texts, with a bounded cache."""

    def __init__(self, path: str, size: int = PARTS):
        table = MergeTable(path)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
        self.by_library = ByteLevel(add_prefix_space=False, use_regex=True)
        split = splitter()
        self.cache = PartCache(lambda t: self.library_split(t) if unknown(t) else split(t), lambda keys: merge_counts([k.encode() for k in keys], table).tolist(), sum, size)

    def library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.by_library.pre_tokenize_str(text)]

    def count_all(self, texts: Iterable[str]) -> Iterator[int]:
        for group in grouped(texts):
            cut = [self.cut.split(t) if self.cut and self.cut.search(t) else [t] for t in group]
            found = map(sum, self.cache.of_all([x for parts in cut for x in parts]))
            for parts in cut:
                yield len(parts) - 1 + sum(next(found) for _ in parts)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs(doc_id, text). One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident(("token-counts", path), lambda: Counter(path))
        for batch in batches:
            texts = [t or b"" for t in byte_texts(batch.column("text"))]
            tokens = list(counter.count_all(t.decode() for t in texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
