"""How far the sources of a language differ in their words: pair and term divergences.

Single-pass in-memory indexing: a task counts the terms of its texts in a dictionary
of postings (language, source, term), until it holds POSTINGS of them; then it spills
them as a run, sorted by term within each hash shard and cut in blocks. Spark deals
the blocks by shard and sorts them by their first term, and the shard's task merges
the runs with a heap: a block is opened when the merge reaches its first term, so
that one block of each run is held, whatever the vocabulary. What comes out are the
frequencies, a row per kept term with the sources that have it.

A pair's value sums over all kept terms, most of which either source lacks. If both
lack all terms it is V times one number; that is corrected by each source's counts,
of which only the distinct ones matter, and by the terms that both have, which stream
through once more. No pair of sources is formed for a term that neither has. What
grows with pairs of sources is the result alone.

All arithmetic is exact: Python integers or, where they fit, 64-bit ones.

Defined results: null text, language and source count as ''; a group without kept
terms has its pairs (value 0 if its language keeps none) and no terms; a language
with one source has no pairs; equal rows count each; document ids are not read. A
text of any length is counted whole. No rows, no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.llm.common import byte_texts, joined, scratch, stored, table_file, table_files

#: A language keeps the terms that so many of its documents have.
LEAST_DOCS = 3
#: A probability of 1, and the count that every term has besides.
ONE, PRIOR = 1_000_000_000, 1
#: Terms of a group that are reported.
RANKS = 200
#: Postings that a task holds before it spills a run; postings of a run's block at most; terms that are corrected together.
POSTINGS, BLOCK, TOGETHER = 400_000, 500, 4_096
#: Pairs of sources of terms that are corrected at once, unless one term has more.
PAIRS = 1 << 20

#: A-Z to a-z and all other ASCII to a space, for bytes.translate.
TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

BLOCKS = "shard int, lang string, head binary, terms array<binary>, docs array<long>, sizes array<int>, sources array<string>, counts array<long>"
KINDS = [pa.int32(), pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64())]
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


class Postings:
    """Counts of each term by (language, source), and documents by language, up to a number of entries."""

    def __init__(self, most: int):
        self.most = most
        self.restart()

    def restart(self) -> None:
        self.held, self.counts, self.docs = 0, defaultdict(Counter), defaultdict(Counter)

    def add(self, lang: str, source: str, text: bytes | None) -> bool:
        """True when it is time to spill."""
        words, own = (text or b"").translate(TERMS).split(), self.counts[lang, source]
        before = len(own)
        own.update(words)
        self.docs[lang].update(set(words))
        self.held += len(own) - before
        return self.held >= self.most

    def spilled(self, shards: int, block: int) -> Iterator[tuple]:
        """The run's blocks (shard, lang, head, terms, docs, sizes, sources, counts), in order of language, shard and term. Empties it."""
        for lang, docs in self.docs.items():
            if not docs:
                continue
            own = [(source, counts) for (g, source), counts in self.counts.items() if g == lang]
            terms = sorted(docs)
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % shards
            dealt = np.argsort(shard, kind="stable")
            terms, shard = [terms[k] for k in dealt.tolist()], shard[dealt]
            place = dict(zip(terms, range(len(terms))))
            at = np.concatenate([np.fromiter(map(place.__getitem__, counts), np.int64, len(counts)) for _, counts in own])
            order = np.argsort(at, kind="stable")
            counts = np.concatenate([np.fromiter(counts.values(), np.int64, len(counts)) for _, counts in own])[order]
            sources = np.repeat(np.array([source for source, _ in own], object), [len(counts) for _, counts in own])[order]
            docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            sizes = np.bincount(at, minlength=len(terms))
            ends, stops = np.cumsum(sizes), np.searchsorted(shard, shard, "right")
            first = 0
            while first < len(terms):
                a = int(ends[first] - sizes[first])
                stop = min(int(np.searchsorted(ends, a + block)) + 1, int(stops[first]))
                b = int(ends[stop - 1])
                yield int(shard[first]), lang, terms[first], terms[first:stop], docs[first:stop], sizes[first:stop], sources[a:b], counts[a:b]
                first = stop
        self.restart()


def runs(docs: DataFrame, shards: int, text: str, lang: str, source: str, postings: int, block: int) -> DataFrame:
    """The blocks of all runs."""

    def lists(parts: tuple, kind: pa.ListType) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind.value_type))

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        whole = [pa.array(c, k) for c, k in zip(columns[:4], KINDS)]
        return pa.RecordBatch.from_arrays([*whole, *(lists(c, k) for c, k in zip(columns[4:], KINDS[4:]))], NAMES)

    def spill(held: Postings) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for row in held.spilled(shards, block):
            rows.append(row)
            n += len(row[-1])
            if n >= 50 * block:
                yield packed(rows)
                rows, n = [], 0
        if rows:
            yield packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(postings)
        for batch in batches:
            for g, s, t in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), byte_texts(batch.column("text"))):
                if held.add(g, s, t):
                    yield from spill(held)
        yield from spill(held)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(text).alias("text")).mapInArrow(run, BLOCKS)


#: Blocks that become Python values at once.
OPENED = 64


def listed(flat: pa.Array) -> list:
    """Python values; the few distinct sources are made once."""
    if pa.types.is_string(flat.type):
        codes = flat.dictionary_encode()
        return np.array(codes.dictionary.to_pylist(), object)[np.asarray(codes.indices)].tolist()
    return flat.to_numpy(zero_copy_only=False).tolist()


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of BLOCKS as Python values, a few at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, OPENED):
            part = batch.slice(a, OPENED)
            lists = []
            for column in part.columns[3:]:
                flat, ends = listed(column.flatten()), np.cumsum(column.value_lengths().to_numpy()).tolist()
                lists.append([flat[x:y] for x, y in zip([0, *ends], ends)])
            yield from zip(*(c.to_pylist() for c in part.columns[:3]), *lists)


def merged(blocks: Iterable[tuple]) -> Iterator[tuple[bytes, int, dict[str, int]]]:
    """(term, docs, counts by source) of blocks (head, terms, docs, sizes, sources, counts) in order of head, by term: a heap of the open blocks."""
    heap: list[tuple[bytes, int]] = []
    held: dict[int, list] = {}

    def least() -> tuple[bytes, int, dict[str, int]]:
        term, n, sums = heap[0][0], 0, {}
        while heap and heap[0][0] == term:
            number = heap[0][1]
            block = held[number]
            k, at, terms, docs, sizes, sources, counts = block
            n += docs[k]
            stop = at + sizes[k]
            for p in range(at, stop):
                source = sources[p]
                sums[source] = sums.get(source, 0) + counts[p]
            k += 1
            if k < len(terms):
                block[0], block[1] = k, stop
                heapq.heapreplace(heap, (terms[k], number))
            else:
                heapq.heappop(heap)
                del held[number]
        return term, n, sums

    for number, (head, *columns) in enumerate(blocks):
        while heap and heap[0][0] < head:
            yield least()
        held[number] = [0, 0, *columns]
        heapq.heappush(heap, (head, number))
    while heap:
        yield least()


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, shards: int | None = None, postings: int = POSTINGS, block: int = BLOCK) -> DataFrame:
    """(lang, term, n, sources, counts) of the terms that at least least_docs documents of the language have; sources sorted."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs(docs, shards, text, lang, source, postings, block).repartition(shards, "shard").sortWithinPartitions("shard", "lang", "head")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (_, own), blocks in groupby(opened(batches), itemgetter(0, 1)):
            for term, n, counts in merged(b[2:] for b in blocks):
                if n >= least_docs:
                    sources = sorted(counts)
                    rows.append((own, term, sum(counts.values()), sources, [counts[s] for s in sources]))
                    if len(rows) >= 10_000:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        arrays[1] = arrays[1].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, ["lang", "term", "n", "sources", "counts"])

    return dealt.mapInArrow(run, "lang string, term string, n long, sources array<string>, counts array<long>")


def totals(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, total, terms, lang_total): every group that occurs, its occurrences of kept terms, and the kept terms and occurrences of its language."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    own = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("total"))
    whole = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total"))


def exact(numbers: Iterable[int]) -> np.ndarray:
    """64-bit integers if a probability of each can be computed in them, else Python's."""
    numbers = list(numbers)
    fits = max(numbers, default=0) < (1 << 63) // ONE - PRIOR
    return np.array(numbers, np.int64 if fits else object)


def share(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    return 1 + ONE * (counts + PRIOR) // np.maximum(total + PRIOR * terms, 1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Language:
    """Groups of one language: sources in order, their totals, the number of kept terms."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=itemgetter("source"))
        self.sources = [r["source"] for r in rows]
        self.place = {s: n for n, s in enumerate(self.sources)}
        self.totals, self.terms = exact(r["total"] for r in rows), rows[0]["terms"]
        self.absent = share(np.zeros(len(rows), self.totals.dtype), self.totals, self.terms)


def languages(path: str) -> dict[str, Language]:
    """The groups in a stored table: one row a group, as the result has one a pair of them."""
    found = defaultdict(list)
    for name in table_files(path):
        for row in table_file(path, name).to_pylist():
            found[row["lang"]].append(row)
    return {lang: Language(rows) for lang, rows in found.items()}


PAIR_SUMS = "lang string, a string, b string, value string"


class PairSums:
    """Sums of ordered pairs of sources by language, in Python's integers."""

    def __init__(self, path: str):
        self.known = languages(path)
        self.sums: dict[str, np.ndarray] = {}

    def of(self, lang: str) -> np.ndarray:
        if lang not in self.sums:
            n = len(self.known[lang].sources)
            self.sums[lang] = np.zeros((n, n), object)
        return self.sums[lang]

    def batch(self) -> pa.RecordBatch:
        """What isn't 0, in PAIR_SUMS."""
        rows = [(lang, self.known[lang].sources[a], self.known[lang].sources[b], str(sums[a, b])) for lang, sums in self.sums.items() for a, b in zip(*np.nonzero(sums)) if a != b]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * 4], ["lang", "a", "b", "value"])


def summed(found: DataFrame) -> DataFrame:
    return found.groupBy("lang", "a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))


def corrections(terms: DataFrame, groups: str) -> DataFrame:
    """(lang, a, b, value): of each ordered pair of sources, what the terms that both have add to the sum of the two one-sided forms."""

    def correct(own: Language, rows: list[tuple[list[str], list[int]]], sums: np.ndarray) -> None:
        sizes = np.array([len(s) for s, _ in rows])
        squares = sizes * sizes
        place = np.array([own.place[s] for sources, _ in rows for s in sources])
        p = share(exact(n for _, counts in rows for n in counts), own.totals[place], own.terms)
        left = np.repeat(np.arange(len(place)), np.repeat(sizes, sizes))
        within = np.arange(len(left)) - np.repeat(np.cumsum(squares) - squares, squares)
        right = np.repeat(np.cumsum(sizes) - sizes, squares) + within % np.repeat(sizes, squares)
        a, b = place[left], place[right]
        none_a, none_b = own.absent[a], own.absent[b]
        add = divergence(p[left], p[right]) - divergence(p[left], none_b) - divergence(none_a, p[right]) + divergence(none_a, none_b)
        key = a * len(own.sources) + b
        order = np.argsort(key, kind="stable")
        firsts = np.flatnonzero(np.diff(key[order], prepend=-1))
        np.add.at(sums.reshape(-1), key[order][firsts], np.add.reduceat(add[order].astype(object), firsts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(groups)
        for batch in batches:
            held, n, lang = [], 0, None
            for g, s, c in zip(*(batch.column(x).to_pylist() for x in ("lang", "sources", "counts"))):
                if held and (g != lang or len(held) >= TOGETHER or n + len(s) ** 2 > PAIRS):
                    correct(sums.known[lang], held, sums.of(lang))
                    held, n = [], 0
                lang = g
                if len(s) > 1:
                    held.append((s, c))
                    n += len(s) ** 2
            if held:
                correct(sums.known[lang], held, sums.of(lang))
        yield sums.batch()

    return summed(terms.select("lang", "sources", "counts").mapInArrow(run, PAIR_SUMS))


def one_sided(terms: DataFrame, groups: str) -> DataFrame:
    """(lang, a, b, value): what the terms of either source add to the pair's base as if the other had none of them.

    From the distinct counts of each source: (lang, source, count, number of terms).
    """
    counts = terms.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("count")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums(groups)
        for batch in batches:
            for g, s, count, n in zip(*(c.to_pylist() for c in batch.columns)):
                own, matrix = sums.known[g], sums.of(g)
                a = own.place[s]
                p, none = share(exact([count]), own.totals[a : a + 1], own.terms), own.absent
                matrix[a, :] += n * (divergence(p, none) - divergence(none[a], none)).astype(object)
                matrix[:, a] += n * (divergence(none, p) - divergence(none, none[a])).astype(object)
        yield sums.batch()

    return summed(counts.mapInArrow(run, PAIR_SUMS))


def pair_values(terms: DataFrame, groups: DataFrame, path: str) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language. groups: the stored totals at path."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("total").alias("item_total"))
    p, q = ((F.lit(1) + F.expr(f"({ONE}L * {PRIOR}) div greatest({c} + {PRIOR} * terms, 1)")).cast("decimal(38,0)") for c in ("total", "item_total"))
    both = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", "terms", p.alias("p"), q.alias("q"))  # the result's own rows
    base = both.withColumn("base", F.expr("cast(((p - q) * (p - q)) div q as decimal(38,0)) * terms"))
    side, joint = (d.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), F.col("value").alias(name)) for d, name in ((one_sided(terms, path), "side"), (corrections(terms, path), "joint")))
    found = base.join(side, ["lang", "source", "item"], "left").join(joint, ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select("lang", "source", "item", F.when(F.col("terms") == 0, F.lit(0)).otherwise(zero("base") + zero("side") + zero("joint")).cast("long").alias("value"))


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each group's terms that are more probable in it than in its language."""
    rows = terms.select("lang", F.col("term").alias("item"), "n", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), "item", F.col("e.counts").cast("decimal(20,0)").alias("c"), F.col("n").cast("decimal(20,0)").alias("n"))
    d = joined(rows, groups, ["lang", "source"])
    d = d.withColumn("p", F.expr(f"1 + ((c + {PRIOR}) * {ONE}) div (total + {PRIOR} * terms)")).withColumn("q", F.expr(f"1 + ((n + {PRIOR}) * {ONE}) div (lang_total + {PRIOR} * terms)"))
    return d.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = RANKS, **options) -> DataFrame:
    """lang, source, part, item, value, rank: pairs in all ranks, terms to `ranks`."""
    terms = stored(frequencies(docs, text, lang, source, **options), "frequencies")
    path = scratch(docs.sparkSession, "groups")
    totals(docs, terms, lang, source).write.parquet(path)
    groups = docs.sparkSession.read.schema("lang string, source string, total long, terms long, lang_total long").parquet(path)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item"))
    pairs = pair_values(terms, groups, path).withColumn("rank", F.row_number().over(order))
    best = term_values(terms, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").union(columns(best, "term"))
