"""Near-duplicate documents by ProbMinHash signatures, banding and verification.

Texts are word sequences (ASCII letters folded, words as in the decontamination
operator); equal sequences are one node, whatever their number. A node is the
weighted set of its shingles of five words; a shingle weighs its count. ProbMinHash:
each shingle emits arrivals of a Poisson process whose rate is its weight; an arrival
falls into a random slot and a slot keeps its earliest one; a shingle stops as soon as
its next arrival is later than the latest slot. Two signatures agree in a slot with
the probability Jaccard similarity of the weights. Slots are banded; nodes that share
a band are candidates. Weights by count alone would hide copies whose passages repeat
differently, so a node with repeated shingles also has the bands of its plain set, in
which each weighs 1 (most nodes repeat none, for them both are the same bands).
A candidate becomes a link if the exact similarity reaches the threshold: the
probability Jaccard of the counts, or that of the plain sets, which is their Jaccard
similarity. Classes are connected components of links.

No bucket is expanded into all its pairs. First each node is held against one
representative, the bucket minimum it shares most bands with. In a few turns, nodes whose bucket holds
another component are held against one other hub each. Last, the nodes outside a
bucket's largest component are compared with the bucket's nodes of other
components by size and a parity bitmap, an exact filter inside the join; only
pairs that pass leave it to be verified, each from the first bucket that it shares.
Nothing of a whole bucket is in one task: representatives are map-side minima,
and a join by bucket broadcasts its smaller side behind a count or, past that, is
a sorted join whose skewed buckets Spark splits. Probability of a pair at similarity 0.8 sharing
no band of the defaults: (1 - 0.8^4)^24, under 4e-6.

Defined results: fewer than five words, but not none, are one shingle. A text
without words equals only the same text; a null text is a class of its own per
row. Equal rows are in one class; null ids take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.llm.common import ASCII_WORDS, byte_texts, joined, resident, stored, unused

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
#: Shingles that one numpy batch holds at most, unless a single text has more.
BATCH_SHINGLES = 100_000
WORD_CACHE = 100_000
#: Rows of node ids up to which the texts to verify are found by a broadcast.
BROADCAST_ROWS = 500_000

#: The same for rows with parity bitmaps and lists of bands, about 400 bytes each.
WIDE_ROWS = 25_000

#: 64-bit words of a node's parity bitmap.
PARITY = 16
#: Turns in which nodes of different components in one bucket are held against a hub, before the rest is compared in full.
HUB_TURNS = 4

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


#: One odd multiplier for each word of a shingle.
PLACES = mixed(np.arange(SHINGLE, dtype=np.uint64)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hash by word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return h


def word_hashes() -> WordHashes:
    return resident(("word-hashes",), WordHashes)


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the word windows, in order, with repeats."""
    hashes = word_hashes()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    out = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out += h[j : j + n] * PLACES[j]
    return mixed(out ^ np.uint64(min(len(h), SHINGLE)))


def node_key(text: bytes | None, words: list[bytes]) -> bytes | None:
    """128 bits of the word sequence; of the text itself if it has no word; null for null."""
    if text is None:
        return None
    return blake2b(b" ".join(words) if words else b"\0" + text, digest_size=16).digest()


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """ProbMinHash of many weighted sets at once: (docs, slots) element hashes; 0 where a set is empty."""
    value = np.full(docs * slots, np.inf)
    kept = np.zeros(docs * slots, np.uint64)
    time = np.zeros(len(elements))
    state = elements
    while len(elements):
        state = mixed(state)
        time = time - np.log((state >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights
        slot = ((mixed(state) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64) + owner * slots
        np.minimum.at(value, slot, time)
        first = value[slot] == time
        kept[slot[first]] = elements[first]
        on = time < value.reshape(docs, slots).max(axis=1)[owner]
        elements, weights, owner, time, state = elements[on], weights[on], owner[on], time[on], state[on]
    return kept.reshape(docs, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(docs, bands) int64, the band's number mixed in."""
    h = np.tile(mixed(np.arange(bands, dtype=np.uint64)), (len(signature), 1))
    for r in range(rows):
        h = mixed(h ^ signature.reshape(len(signature), bands, rows)[:, :, r])
    return h.view(np.int64)


def keyed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with the node key of each row; also that column's name."""
    name = unused(docs, "node_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [node_key(t, t.translate(ASCII_WORDS).split() if t else []) for t in byte_texts(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])), name


def sketched(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(id, key, bands) of each row; a task gives a node's bands once per batch, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            out: list[list[int] | None] = [None] * batch.num_rows
            seen: set[bytes] = set()
            parts, where, held = [], [], 0

            def flush() -> None:
                if not where:
                    return
                sets = [np.unique(p, return_counts=True) for p in parts]
                twice = [n for n, (_, c) in enumerate(sets) if c.max() > 1]
                own = [(u, np.ones(len(u))) for u, _ in sets] + [(sets[n][0], sets[n][1].astype(np.float64)) for n in twice]
                owner = np.repeat(np.arange(len(own)), [len(u) for u, _ in own])
                sig = signatures(np.concatenate([u for u, _ in own]), np.concatenate([w for _, w in own]), owner, len(own), bands * rows)
                found = band_hashes(sig, bands, rows).tolist()
                for at, row in zip(where, found):
                    out[at] = row
                for n, row in zip(twice, found[len(sets) :]):
                    out[where[n]] = list(dict.fromkeys(out[where[n]] + row))

            for n, t in enumerate(byte_texts(batch.column(text))):
                words = t.translate(ASCII_WORDS).split() if t else []
                keys.append(node_key(t, words))
                if words and keys[-1] not in seen:
                    seen.add(keys[-1])
                    if held and held + len(words) > BATCH_SHINGLES:
                        flush()
                        parts, where, held = [], [], 0
                    parts.append(shingles(words))
                    where.append(n)
                    held += len(words)
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], ["id", "key", "bands"])

    return docs.select(doc_id, text).mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, key binary, bands array<long>")


def contents(docs: DataFrame, keys: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, grams, counts, n, total, parity) of the wanted nodes: their n sorted distinct shingle hashes, from the texts of their least ids.

    counts: how often each occurs, null if all do once; total: all of them. parity: PARITY words of 64 bits;
    a shingle flips one bit.
    """
    ids = nodes.join(keys, "key", "left_semi").select("id").distinct()
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found = found.join(F.broadcast(ids) if small else ids, found["doc"].eqNullSafe(ids["id"]), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {}
            for t in byte_texts(batch.column("text")):
                words = t.translate(ASCII_WORDS).split() if t else []
                key = node_key(t, words)
                if words and key not in got:
                    grams, counts = np.unique(shingles(words), return_counts=True)
                    bits = np.bincount((grams >> np.uint64(20)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
                    got[key] = (grams.tobytes(), counts.astype(np.uint32).tobytes() if counts.max() > 1 else None, len(grams), int(counts.sum()), np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())
            cols = list(zip(*got.values())) or [()] * 5
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["key", "grams", "counts", "n", "total", "parity"])

    return found.mapInArrow(run, "key binary, grams binary, counts binary, n long, total long, parity array<long>").dropDuplicates(["key"]).join(keys, "key", "left_semi")


def may_match(a: str, b: str, threshold: float) -> Column:
    """Whether two sets can reach the threshold: sizes are near, and parities differ in no more bits than the sets may.

    Each shingle of one set alone flips one bit, so differing bits never outnumber
    them: no pair over the threshold is lost. The sizes' difference then says how many each
    side has alone, at least. By counts, with masses U and W of either side alone, the probability Jaccard
    is at most 1 / (1 + U / (1 - U) + W / (1 - W)), as its terms are concave in the shares of
    the common shingles; a shingle alone has at least 1 of its side's total.
    """
    n, m = F.col(a + "n"), F.col(b + "n")
    apart = sum((F.bit_count(F.col(f"{a}p{k}").bitwiseXOR(F.col(f"{b}p{k}"))) for k in range(PARITY)), F.lit(0))
    sets = (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (apart <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    t, u = F.col(a + "total"), F.col(b + "total")
    x, y = F.greatest(F.lit(0.0), (apart + n - m) / 2), F.greatest(F.lit(0.0), (apart + m - n) / 2)
    return sets | ((t + u > n + m) & (x < t) & (y < u) & (x * (u - y) + y * (t - x) <= (1 / threshold - 1 + 1e-9) * (t - x) * (u - y)))


def probability_jaccard(u: np.ndarray, cu: np.ndarray, v: np.ndarray, cv: np.ndarray) -> float:
    """Of two weighted sets with sorted distinct elements: the sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i).

    In order of x / y, those after i count with x and the others with y, so two running
    sums give every i's denominator.
    """
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    x, y = cu[i].astype(np.float64), cv[j].astype(np.float64)
    order = np.argsort(x / y)
    x, y = x[order], y[order]
    after = cu.sum() - x.cumsum()  # those only in u are after all
    upto = cv.sum() - y.sum() + y.cumsum()  # those only in v before all
    return float((1 / (after / x + upto / y)).sum())


def verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles reach the threshold, by their sets or by their counts."""
    side = lambda a, x: grams.select(F.col("key").alias(a), F.col("grams").alias(x), F.col("counts").alias(x + "n"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "xn", "y", "yn")

    def counts(scalar: pa.Scalar, n: int) -> np.ndarray:
        return np.frombuffer(scalar.as_buffer(), np.uint32) if scalar.is_valid else np.ones(n, np.uint32)

    def near(x: pa.Scalar, xn: pa.Scalar, y: pa.Scalar, yn: pa.Scalar) -> bool:
        u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
        if min(len(u), len(v)) >= threshold * max(len(u), len(v)):
            common = len(u) + len(v) - len(np.union1d(u, v))
            if common >= threshold * (len(u) + len(v) - common) - 1e-9:
                return True
        return (xn.is_valid or yn.is_valid) and probability_jaccard(u, counts(xn, len(u)), v, counts(yn, len(v))) >= threshold - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near(*row) for row in zip(*(batch.column(c) for c in ("x", "xn", "y", "yn")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in edges(a, b): the component's least node.

    Each round takes the least label among the neighbours, then jumps to the
    label's own label; rounds are logarithmic in practice and each is stored.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = stored(step.join(jump, "comp").select("node", "was", F.least("comp", "next").alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.where("was != comp").isEmpty():
            return labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): rows(id, key) of docs; nodes(key, id, copies, comp): the least id, the row count and the class of each key."""
    sketches = stored(sketched(docs, doc_id, text, bands, rows), "sketches")
    nodes = stored(sketches.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("bands", ignorenulls=True).alias("bands")), "nodes")
    banded = nodes.where("bands IS NOT NULL").select("key", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.min("key").alias("rep"), F.max("key").alias("last")).where("rep != last").select("band", "rep"), "buckets")
    members = stored(banded.join(buckets, "band"), "members")
    star = members.where("key != rep").groupBy("key", "rep").agg(F.count("*").alias("bands"))
    star = stored(star.groupBy("key").agg(F.max(F.struct("bands", "rep"))["rep"].alias("rep")).select(F.col("key").alias("a"), F.col("rep").alias("b")), "stars")
    grams = stored(contents(docs, members.select("key").distinct(), nodes, doc_id, text), "grams")
    links = stored(verified(star, grams, threshold), "links")
    labels = components(links)
    shape = grams.select("key", "n", "total", *(F.col("parity")[k].alias(f"p{k}") for k in range(PARITY)))
    placed = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("comp", "key").alias("comp"))
    placed = stored(mixed_only(placed).join(shape, "key"), "placed")
    moves: list[DataFrame] = []
    for turn in range(HUB_TURNS + 1):
        if placed.isEmpty():
            break
        pairs = hub_pairs(placed, turn, threshold) if turn < HUB_TURNS else stray_pairs(placed, threshold)
        more = stored(verified(pairs.select("a", "b").distinct(), grams, threshold), "links")
        if more.isEmpty():
            continue
        comp = placed.select("key", "comp").distinct()
        bridges = more.join(comp.select(F.col("key").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("key").alias("b"), F.col("comp").alias("cb")), "b")
        moved = stored(components(bridges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("root")), "moved")
        placed = stored(mixed_only(rerooted(placed, moved)), "placed")
        moves.append(moved)
    nodes = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "id", "copies", F.coalesce("comp", "key").alias("comp"))
    for moved in moves:
        nodes = rerooted(nodes, moved)
    return sketches.select("id", "key"), stored(nodes.select("key", "id", "copies", "comp"), "classes")


def rerooted(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """rows with the component's new root where it has one."""
    columns = rows.columns
    return rows.join(moved.select("comp", "root"), "comp", "left").select(*(F.coalesce("root", "comp").alias("comp") if c == "comp" else F.col(c) for c in columns))


def mixed_only(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components."""
    mixed_up = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("band")
    return joined(placed, mixed_up, "band", "left_semi")


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("band", *(F.col(c).alias(prefix + c) for c in rows.columns if c != "band"))


def hub_pairs(placed: DataFrame, turn: int, threshold: float) -> DataFrame:
    """Per node of a mixed bucket one hub to be held against: another turn, other hubs. Linear in the rows."""
    hubs = placed.groupBy("band").agg(F.min_by("key", F.struct(F.xxhash64("key", F.lit(turn)), "key")).alias("key"))
    hubs = prefixed(joined(placed, hubs, ["band", "key"], "left_semi"), "h_")  # a row for each bucket
    found = joined(placed, hubs, "band", bound=WIDE_ROWS).where((F.col("comp") != F.col("h_comp")) & may_match("", "h_", threshold))
    best = found.groupBy("key", "h_key").agg(F.count("*").alias("bands")).groupBy("key").agg(F.max(F.struct("bands", "h_key"))["h_key"].alias("b"))
    return best.select(F.col("key").alias("a"), "b")


def stray_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """Each bucket's nodes outside its largest component with all nodes of other components that may match, each pair once.

    All buckets that two components share are mixed, so that a pair is there in the
    first bucket that its nodes share, and comes out in that one alone.
    """
    main = placed.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"))
    before = F.collect_list("band").over(Window.partitionBy("key").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))  # a node's bands at most
    rows = joined(stored(placed.withColumn("before", before), "before"), main, "band").withColumn("stray", F.col("comp") != F.col("main")).drop("main")
    strays = prefixed(rows.where("stray"), "s_")
    once = ~F.arrays_overlap("s_before", "before") & (~F.col("stray") | (F.col("s_key") < F.col("key")))
    found = joined(rows, strays, "band", bound=WIDE_ROWS).where((F.col("s_comp") != F.col("comp")) & may_match("s_", "", threshold) & once)
    return found.select(F.least("s_key", "key").alias("a"), F.greatest("s_key", "key").alias("b"))


def report(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the class's least doc_id), class_size (rows)."""
    rows, nodes = classes(docs, **settings)
    whole = nodes.groupBy("comp").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    known = nodes.join(whole, "comp").select("key", "class_id", "class_size")
    found = rows.where("key IS NOT NULL").join(known, "key").select(F.col("id").alias("doc_id"), "class_id", "class_size")
    return found.union(rows.where("key IS NULL").select("id", F.col("id"), F.lit(1).cast("long")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs, all columns, with one row of each class: the least id's; rows with a null text all stay."""
    _, nodes = classes(docs, doc_id, text, **settings)
    best = nodes.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("best")).select(F.col("best.key").alias("k"), F.col("best.id").alias("i"))
    rows, key = keyed(docs, text)
    filled = rows.where(F.col(key).isNotNull()).dropDuplicates([key, doc_id])
    kept = filled.join(best, (filled[key] == best["k"]) & filled[doc_id].eqNullSafe(best["i"]), "left_semi")
    return kept.select(docs.columns).union(docs.where(F.col(text).isNull()))
