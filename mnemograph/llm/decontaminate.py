"""Benchmark decontamination with a generalised suffix automaton over words.

The test items' words form one automaton per block of bounded size; the blocks are
files of the shared folder. Training texts stream through word by word; the state
gives the longest suffix of the text that occurs in some item. A window (13
consecutive item words, or a whole shorter item) is found where that length
reaches it. Texts aren't shuffled and the items aren't gathered: a task holds one
automaton at a time. With one block it keeps it for all its texts; with more it
goes through the blocks for each slab of texts and joins what they find.

Defined results: a null text has no words and no hits; an empty item has no
window; repeated items count with each of their ids; windows of an item with a
null id are hits, but it isn't among the items. Null document ids are kept.
Repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.llm.common import ASCII_WORDS, byte_texts, resident, scratch, table_file, table_files

WINDOW = 13
#: Item words per automaton; an automaton has at most twice as many states.
BLOCK_WORDS = 500_000
#: A text is contaminated from this share of hit words on: 1 in 20.
COVERAGE = 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ASCII_WORDS).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word lists, with the windows' item sets."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.items: dict[int, set[str | None]] = {}

    def _clone(self, p: int, q: int, word: bytes) -> int:
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        clone = len(self.len) - 1
        self.link[q] = clone
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:  # another item has brought this prefix
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, q, word)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        cur, p = len(self.len) - 1, last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, word)
        return cur

    def add(self, words: list[bytes]) -> None:
        state = 0
        for w in words:
            state = self._extend(state, w)

    def mark(self, words: list[bytes], item: str | None) -> None:
        """Note the item at the state of each of its windows. After all add()."""
        state, want = 0, min(self.window, len(words))
        for i, w in enumerate(words):
            state = self.next[state][w]
            while self.len[self.link[state]] >= want:
                state = self.link[state]
            if i + 1 >= want:
                self.items.setdefault(state, set()).add(item)

    def seal(self) -> None:
        """For each state, the nearest marked state at it or on its suffix path."""
        order = sorted(range(len(self.len)), key=self.len.__getitem__)
        self.marked = [0] * len(self.len)
        for s in order[1:]:
            self.marked[s] = s if s in self.items else self.marked[self.link[s]]
        # a marked state stands for strings of one length: the window, or a whole shorter item
        self.size = {s: min(self.window, self.len[s]) for s in self.items}

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged [from, to) word spans inside any window's occurrence; the items found."""
        nxt, link, length, marked, size = self.next, self.link, self.len, self.marked, self.size
        root, state, matched = nxt[0], 0, 0
        found: list[tuple[int, int]] = []
        hit: set[int] = set()
        for i, w in enumerate(words):
            if not state:
                state = root.get(w, 0)
                if not state:
                    continue
                matched = 1
            else:
                to = nxt[state].get(w)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = nxt[state].get(w)
                if to is None:
                    matched = 0
                    continue
                state, matched = to, matched + 1
            m = marked[state]
            while m:
                if size[m] <= matched:
                    found.append((i + 1 - size[m], i + 1))
                    hit.add(m)
                m = marked[link[m]]
        found.sort()
        merged: list[list[int]] = []
        for a, b in found:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], set().union(*(self.items[s] for s in hit))


def build(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> SuffixAutomaton:
    sam = SuffixAutomaton(window)
    for _, words in items:
        sam.add(words)
    for item, words in items:
        sam.mark(words, item)
    sam.seal()
    return sam


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> str:
    """The items as a stored table with one block a file; its path. Long items are cut with an overlap that keeps every window."""
    d = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    piece = max(block_words, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, total = [], [], 0
        for batch in batches:
            for item, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(t)
                for at in range(0, max(1, len(words) - window + 1), piece - window + 1) if words else ():
                    part = words[at : at + piece]
                    if names and total + len(part) > block_words:
                        yield block_row(names, texts)
                        names, texts, total = [], [], 0
                    names.append(item)
                    texts.append(b" ".join(part))
                    total += len(part)
        if names:
            yield block_row(names, texts)

    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = scratch(items.sparkSession, "item-blocks")
    d.repartition(1 + size // (4 * block_words)).mapInArrow(run, "items array<string>, texts array<binary>").write.option("maxRecordsPerFile", 1).parquet(path)
    return path


def block_row(names: list[str | None], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.binary()))], ["items", "texts"])


def automata(path: str, window: int) -> list[Callable[[], SuffixAutomaton]]:
    """A maker of each block's automaton. The last one made stays with the worker."""

    def made(name: str) -> SuffixAutomaton:
        row = table_file(path, name).to_pylist()[0]
        return build([(item, t.split()) for item, t in zip(row["items"], row["texts"])], window)

    names = [n for n in table_files(path) if table_file(path, n).num_rows]
    return [lambda name=name: resident(("automaton", name), lambda: made(name)) for name in names]


#: Bytes of text that a task holds while it goes through several blocks.
SLAB_BYTES = 32 << 20


def slabs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def find_spans(docs: DataFrame, items: DataFrame, finish: Callable[[pa.RecordBatch, list[dict]], pa.RecordBatch], schema: T.StructType | str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs through one pass that ends with finish(batch, hits) for each batch.

    hits per row: n_words, spans (flat from, to pairs) and items.
    """
    path = item_blocks(items, item_id, item_text, window, block_words)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        makers = automata(path, window)
        for held in slabs(batches, SLAB_BYTES if len(makers) > 1 else 1):
            texts = [t for batch in held for t in byte_texts(batch.column(text))]
            found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
            sizes = [0] * len(texts)
            for make in makers or [SuffixAutomaton]:
                sam = make()
                for n, t in enumerate(texts):
                    words = words_of(t)
                    sizes[n] = len(words)
                    if makers:
                        spans, hit = sam.spans(words)
                        if spans:
                            found[n] = union([*found[n][0], *spans]), found[n][1] | hit
            rows = [{"n_words": size, "spans": [x for s in spans for x in s], "items": sorted(i for i in hit if i is not None)} for size, (spans, hit) in zip(sizes, found)]
            at = 0
            for batch in held:
                yield finish(batch, rows[at : at + batch.num_rows])
                at += batch.num_rows

    return docs.mapInArrow(search, schema)


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def n_hit(hits: dict) -> int:
    return sum(hits["spans"][1::2]) - sum(hits["spans"][::2])


def is_contaminated(hits: dict, coverage: int = COVERAGE) -> bool:
    n = n_hit(hits)
    return n > 0 and coverage * n >= hits["n_words"]


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""

    def digest(batch: pa.RecordBatch, hits: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([h["n_words"] for h in hits], pa.int64()),
                pa.array([n_hit(h) for h in hits], pa.int64()),
                pa.array([len(h["items"]) for h in hits], pa.int64()),
                pa.array([hashlib.sha256(",".join(h["items"]).encode()).hexdigest() for h in hits], pa.string()),
                pa.array([is_contaminated(h, coverage) for h in hits], pa.bool_()),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return find_spans(docs.select("doc_id", "text"), items, digest, schema, window=window, block_words=block_words)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, coverage: int = COVERAGE, remove_spans: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without contaminated rows, same columns.

    remove_spans: instead of dropping a contaminated text, cut its hit spans out
    (from the first byte of the first hit word to the last byte of the last).
    """
    names = docs.columns

    def keep(batch: pa.RecordBatch, hits: list[dict]) -> pa.RecordBatch:
        bad = [is_contaminated(h, coverage) for h in hits]
        cols = [batch.column(c) for c in names]
        if remove_spans:
            new = [cut(t, h["spans"]) if b else t for t, h, b in zip(byte_texts(batch.column(text)), hits, bad)]
            cols[names.index(text)] = pa.array(new, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(cols, names)
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array([not b for b in bad], pa.bool_()))

    return find_spans(docs, items, keep, docs.schema, text=text, window=window, block_words=block_words)


def cut(text: bytes, spans: list[int]) -> bytes:
    """text without the words of the flat spans."""
    flat, places, at = text.translate(ASCII_WORDS), [], 0
    for w in flat.split():
        at = flat.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, start = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(text[start : places[a][0]])
        start = places[b - 1][1]
    return b"".join([*out, text[start:]])
