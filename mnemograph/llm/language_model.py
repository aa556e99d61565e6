"""Scoring by a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are the words of a text (ASCII letters folded, cut at white space) and one
end. Training tokens of the whole corpus are counted; the most frequent words are
the model's vocabulary, all others fall into TAILS classes by a hash of their last
two bytes. The model predicts a token's vector from the vectors of the two tokens
before it, each weighted per position; its probability is the softmax over
vocabulary and classes, and within a class that of its words' smoothed counts.

Training goes in synchronised rounds. The texts are dealt into blocks of about
BLOCK_TOKENS tokens by a hash of the id, whatever the partitions, and the blocks into
as many rounds as the square root of their number: with the corpus both the rounds
and the blocks that work side by side in one grow. In a round each of its blocks
makes gradient steps from the round's common start, with noise from the unigram
distribution and a seed of its own; the results are averaged, weighted by tokens,
and are the next round's start. Each text is used PASSES times at every size. All
training texts take part, so counts, blocks, rounds and what is averaged grow with
the corpus. Scores are exact
normalised log-probabilities: normalisers come from matrix products, once per
context and worker.

What reaches every task has a fixed bound: the model (VOCAB rows) and the counts
of at most KNOWN_WORDS words. Rarer words are looked up by a join on the word.

Defined results: a null or empty text is its end alone. Without training texts
all counts are 0 and the model is uniform over an empty vocabulary's classes.
Words of equal counts are ranked by their bytes. Repeated rows are counted,
trained on and scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, sqrt
from pickle import dumps, loads
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import byte_texts, id_hash, resident, stored

#: Rows of the model: classes of rarer words, end, begin, and the most frequent words.
VOCAB, TAILS = 1088, 64
SIZE = 16
CONTEXT = 2
#: Words whose counts every task holds, at most: of up to WORD_BYTES bytes, and the most frequent longer ones.
KNOWN_WORDS, LONG_WORDS = 200_000, 1000
WORD_BYTES = 64
#: Tokens of a block on average; rounds.
BLOCK_TOKENS, PASSES = 250_000, 1
#: Distinct words a task counts before it passes them on.
COUNT_WORDS = 300_000
NOISE, BATCH, RATE = 64, 8192, 0.1
SMOOTHING = 0.1
#: Parts of the parameters, each averaged as one vector.
PARTS = 16
END, BEGIN, FIRST = TAILS, TAILS + 1, TAILS + 2
LOG10 = 1 / np.log(10)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; the end's word is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            held[b""] += batch.num_rows
            for t in byte_texts(batch.column(text)):
                held.update(words_of(t))
                if len(held) > COUNT_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail(word: bytes) -> int:
    """Class of a word outside the vocabulary."""
    return crc32(word[-2:]) % TAILS


class Lexicon:
    """Corpus totals and the frequent words' counts. rows: [(word, count)], most frequent first; tails: (class, tokens, words) over all words."""

    def __init__(self, total: int, distinct: int, rows: list[tuple[bytes, int]], end: int, vocab: int, tails: list[tuple[int, int, int]]):
        self.total, self.distinct, self.end = total, distinct, end
        self.words = [w for w, _ in rows]
        self.counts = np.array([c for _, c in rows], np.float64)
        self.vocab = min(len(rows), vocab - FIRST)  # the first so many are the model's own
        self.tails = np.array([tail(w) for w in self.words], np.int64)
        tokens, words = np.zeros(TAILS), np.zeros(TAILS)
        for k, n, m in tails:
            tokens[k], words[k] = n, m
        own = self.tails[: self.vocab]
        tokens -= np.bincount(own, self.counts[: self.vocab], TAILS)
        words -= np.bincount(own, minlength=TAILS)
        #: log10 of each class's smoothed total, one unseen word included
        self.tail_norm = np.log10(tokens + SMOOTHING * (words + 1))
        own = np.concatenate([tokens, [end, 0], self.counts[: self.vocab]]) + SMOOTHING
        own[BEGIN] = 0
        self.unigram = own / own.sum()

    @property
    def base_norm(self) -> float:
        return np.log10(self.total + SMOOTHING * (self.distinct + 1))

    def ids(self) -> np.ndarray:
        """The model's row of each word."""
        at = np.arange(len(self.words))
        return np.where(at < self.vocab, at + FIRST, self.tails)


def lexicon(counts: DataFrame, vocab: int = VOCAB, known: int = KNOWN_WORDS) -> Lexicon:
    """Of the stored word counts. Takes at most `known` words and LONG_WORDS long ones to the driver: those over a count bound found from a histogram."""
    word = F.col("word")
    totals = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(word == b"", F.col("n")))).first()
    named = counts.where(word != b"")
    usable = named.where(F.octet_length("word") <= WORD_BYTES)
    step = F.floor(F.log2("n") * 16)
    bound, room = None, known
    for row in usable.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():  # under a thousand steps
        if row["count"] > room:
            break
        room -= row["count"]
        bound = row["s"]
    rows = [] if bound is None else usable.where(step >= bound).collect()
    rows = [(bytes(r["word"]), r["n"]) for r in [*rows, *named.where(F.octet_length("word") > WORD_BYTES).orderBy(F.desc("n"), "word").limit(LONG_WORDS).collect()]]
    rows.sort(key=lambda r: (-r[1], r[0]))
    tails = named.groupBy((F.crc32(F.substring("word", -2, 2)) % TAILS).alias("k")).agg(F.sum("n"), F.count("*")).collect()  # TAILS rows
    return Lexicon(totals[0] or 0, totals[1], rows, totals[2] or 0, vocab, [tuple(r) for r in tails])


class Parameters:
    """Target vectors q, context vectors r, position weights c, biases b."""

    def __init__(self, flat: np.ndarray, rows: int, size: int = SIZE):
        cut = np.split(flat, np.cumsum([rows * size, rows * size, CONTEXT * size]))
        self.q, self.r, self.c, self.b = cut[0].reshape(rows, size), cut[1].reshape(rows, size), cut[2].reshape(CONTEXT, size), cut[3]

    def predicted(self, before: list[np.ndarray]) -> np.ndarray:
        return sum(self.r[x] * self.c[n] for n, x in enumerate(before))


def start(lex: Lexicon, size: int = SIZE) -> np.ndarray:
    """The common start: small random vectors, biases at the unigram log-probabilities."""
    rows, rng = len(lex.unigram), np.random.default_rng(7)
    bias = np.log(np.maximum(lex.unigram, 1e-12))
    return np.concatenate([rng.normal(0, 0.1, 2 * rows * size), np.ones(CONTEXT * size), bias])


def summed(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of values added up by their index."""
    out = np.zeros((rows, values.shape[1]), values.dtype)
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    out[sorted_at[first]] = np.add.reduceat(values[order], first)
    return out


class Trainer:
    """Noise-contrastive steps (Adagrad) over token ids, in single precision. state: parameters and summed squares of gradients."""

    def __init__(self, state: np.ndarray, unigram: np.ndarray, seed: int):
        self.flat, self.power = (x.astype(np.float32) for x in np.split(state, 2))
        self.p = Parameters(self.flat, len(unigram))  # views into flat
        self.log_noise = np.log(NOISE * np.maximum(unigram, 1e-12)).astype(np.float32)
        self.cumulative, self.rng = np.cumsum(unigram), np.random.default_rng(seed)

    def step(self, target: np.ndarray, before: list[np.ndarray]) -> None:
        p, rows = self.p, len(self.p.b)
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), rows - 1)
        h = p.predicted(before)
        good = np.einsum("ij,ij->i", h, p.q[target]) + p.b[target] - self.log_noise[target]
        false = h @ p.q[noise].T + p.b[noise] - self.log_noise[noise]
        d_good = -1 / (1 + np.exp(np.clip(good, -30, 30)))  # of the loss, by the target's score
        d_false = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
        dh = d_good[:, None] * p.q[target] + d_false @ p.q[noise]
        grad = np.zeros_like(self.flat)
        g = Parameters(grad, rows)
        g.q += summed(rows, target, d_good[:, None] * h)
        np.add.at(g.q, noise, d_false.T @ h)
        g.b += np.bincount(target, d_good, rows)
        np.add.at(g.b, noise, d_false.sum(0))
        for n, x in enumerate(before):
            g.r += summed(rows, x, dh * p.c[n])
            g.c[n] += (dh * p.r[x]).sum(0)
        grad /= len(target)
        self.power += grad * grad
        self.flat -= RATE * grad / np.sqrt(self.power)


def encoded(docs: DataFrame, lex: Lexicon, blocks: int, doc_id: str, text: str) -> DataFrame:
    """(block, place, ids): the model's rows of each text's tokens as 16-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(dumps((lex.words, lex.ids())))
    d = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("string"), F.col(text)).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = loads(shared.value)
        of = dict(zip(words, ids.tolist())).get
        for batch in batches:
            got = []
            for t in byte_texts(batch.column("text")):
                found = words_of(t)
                row = [of(w, -1) for w in found]
                if -1 in row:
                    row = [tail(w) if n < 0 else n for n, w in zip(row, found)]
                got.append(np.array([*row, END], "<i2").tobytes())
            place = batch.column("place")
            block = np.asarray(place) % blocks
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), place, pa.array(got, pa.binary())], ["block", "place", "ids"])

    return d.mapInArrow(run, "block long, place long, ids binary")


def trained_block(table: pa.Table, state: np.ndarray, unigram: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Tokens and state after one pass over a block's texts, in order of their places."""
    trainer, seen = Trainer(state, unigram, seed), 0
    rows = sorted(zip(table.column("place").to_pylist(), table.column("ids").to_pylist()))
    start = np.full(CONTEXT, BEGIN, "<i2").tobytes()
    ids = np.frombuffer(b"".join(x for _, r in rows for x in (start, r)), "<i2").astype(np.int64)
    for a in range(0, max(0, len(ids) - CONTEXT), BATCH):
        seen += learn(trainer, ids[a : a + BATCH + CONTEXT])
    return seen, np.concatenate([trainer.flat, trainer.power])


def train(docs: DataFrame, lex: Lexicon, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, passes: int = PASSES) -> np.ndarray:
    """Parameters after all rounds of all passes."""
    spark, flat = docs.sparkSession, start(lex)
    state = np.concatenate([flat, np.full(len(flat), 1e-6)])
    if not lex.total:
        return flat
    blocks = max(1, round(lex.total / block_tokens))
    rounds = ceil(sqrt(blocks))
    rows = encoded(docs, lex, blocks, doc_id, text).withColumn("turn", F.col("block") % rounds)
    rows = stored(rows.repartitionByRange("turn", "block"), "lm-tokens")  # a round reads its own files
    for turn in range(passes * rounds):
        shared = spark.sparkContext.broadcast(dumps((lex.unigram, state)))
        ended = rows.where(F.col("turn") == turn % rounds).select("block", "place", "ids").groupBy("block").applyInArrow(block_step(shared, turn), "part int, tokens double, values array<double>").where("tokens > 0")
        mean = ended.groupBy("part").agg(vector_to_array(Summarizer.mean(array_to_vector(F.col("values")), F.col("tokens"))).alias("values"))
        got = {r["part"]: np.array(r["values"]) for r in mean.collect()}  # one model
        if got:
            state = np.concatenate([got[n] for n in range(PARTS)])
        shared.unpersist()
    return np.split(state, 2)[0]


def block_step(shared, turn: int):
    """What a round does with one block: its new state in PARTS parts."""

    def run(table: pa.Table) -> pa.Table:
        unigram, begin = loads(shared.value)
        seen, end = trained_block(table, begin, unigram, table.column("block")[0].as_py() * 1000 + turn)
        return pa.table({"part": pa.array(range(PARTS), pa.int32()), "tokens": pa.array([float(seen)] * PARTS), "values": pa.array([p.tolist() for p in np.array_split(end, PARTS)], pa.list_(pa.float64()))})

    return run


def learn(trainer: Trainer, ids: np.ndarray) -> int:
    target = ids[CONTEXT:]
    on = target != BEGIN
    if not on.any():
        return 0
    trainer.step(target[on], [ids[CONTEXT - n - 1 : len(ids) - n - 1][on] for n in range(CONTEXT)])
    return int(on.sum())


class Scorer:
    """Scores of texts but for the counts of words outside the lexicon."""

    def __init__(self, packed: bytes):
        lex, flat = loads(packed)
        self.lex, self.rows = lex, len(lex.unigram)
        self.p = Parameters(flat.astype(np.float32), self.rows)
        self.at, self.ids = {w: n for n, w in enumerate(lex.words)}, lex.ids()
        self.log = np.log10(np.concatenate([lex.counts, [lex.end]]) + SMOOTHING)
        self.norm = np.full(self.rows**CONTEXT, np.nan, np.float32)

    def normalisers(self, context: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        fresh = np.unique(context[np.isnan(self.norm[context])], return_index=False)
        for a in range(0, len(fresh), 4096):
            part = fresh[a : a + 4096]
            h = self.p.predicted([part // self.rows, part % self.rows])
            scores = h @ self.p.q.T + self.p.b
            scores[:, BEGIN] = -np.inf  # never a token
            top = scores.max(1)
            self.norm[part] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return self.norm[context]

    def score(self, text: bytes | None) -> tuple[int, int, float, float, dict[bytes, int]]:
        """Tokens, known tokens, base and model score without the rest's counts, and the rest: words with their numbers."""
        lex, words = self.lex, words_of(text)
        n = len(words) + 1
        get = self.at.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, n - 1)
        known = at >= 0
        ids = np.full(n + CONTEXT, BEGIN, np.int64)
        if len(self.ids):
            ids[CONTEXT:-1] = self.ids[at]
        for k in np.flatnonzero(~known).tolist():
            ids[k + CONTEXT] = tail(words[k])
        ids[-1] = END
        target, before = ids[CONTEXT:], [ids[CONTEXT - k - 1 : n + CONTEXT - k - 1] for k in range(CONTEXT)]
        context = before[0] * self.rows + before[1]
        scores = np.einsum("ij,ij->i", self.p.predicted(before), self.p.q[target]) + self.p.b[target] - self.normalisers(context, before)
        logs = self.log[at[known]]
        base = float(logs.sum() + self.log[-1] - n * lex.base_norm)
        rare = target[:-1] < TAILS
        model = float(scores.sum() * LOG10 + self.log[at[known & rare]].sum() - lex.tail_norm[target[:-1][rare]].sum())
        rest = Counter(w for w, k in zip(words, known.tolist()) if not k) if not known.all() else {}
        return n, int(known.sum()) + (lex.end > 0), base, model, rest


def scorer_of(packed: bytes) -> Scorer:
    """One per Python worker, so that its normalisers outlive a task."""
    return resident(("lm-scorer", blake2b(packed).digest()), lambda: Scorer(packed))


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, flat: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(dumps((lex, flat)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer, number = scorer_of(shared.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = [scorer.score(t) for t in byte_texts(batch.column(text))]
            keys = range(number, number + len(rows))
            number += len(rows)
            rest = pa.array([[{"word": w, "n": c} for w, c in r[4].items()] for r in rows], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(doc_id), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))), rest], ["key", "doc_id", "n_tokens", "n_known", "base_score", "score", "rest"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = stored(docs.select(doc_id, text).mapInArrow(run, f"key long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rest array<struct<word: binary, n: long>>"), "scored")
    rare = found.select("key", F.explode("rest").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    looked_up = rare.join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTHING))).alias("more"),
    )
    heads = found.select("key", F.struct("doc_id", "n_tokens", "n_known", "base_score", "score").alias("h"), F.lit(0).cast("long").alias("more_known"), F.lit(0.0).alias("more"))
    empty = F.lit(None).cast(heads.schema["h"].dataType)
    whole = heads.union(looked_up.select("key", empty, "more_known", "more")).groupBy("key").agg(F.first("h", ignorenulls=True).alias("h"), F.sum("more_known").alias("k"), F.sum("more").alias("m"))
    return whole.select("h.doc_id", "h.n_tokens", (F.col("h.n_known") + F.col("k")).alias("n_known"), (F.col("h.base_score") + F.col("m")).alias("base_score"), (F.col("h.score") + F.col("m")).alias("score"))


def held_out(doc_id: str = "doc_id"):
    return (id_hash(doc_id) % 10) == 0


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows not held out."""
    docs = docs.select("doc_id", "text")
    training = docs.where(~held_out())
    counts = stored(count_words(training), "word-counts")
    lex = lexicon(counts)
    found = score(docs, counts, lex, train(training, lex))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(lex.total).cast("long").alias("train_tokens"), "base_score", "score")
