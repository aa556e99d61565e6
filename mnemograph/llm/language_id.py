"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (1 to 3, the blended
spectrum) present in both, divided by the root of the product of their numbers of
distinct n-grams. Landmark texts give a Nyström feature map, on which one ridge
regression per language is solved in closed form. Scoring is one product of a
batch's presence matrix with the landmarks' and one with the weights.

Fitted on a bounded sample: about SAMPLE_DOCS labelled texts, drawn by a hash of
their id with equal shares of the languages (the SAMPLE_DOCS / 8 most frequent
ones), of at most SAMPLE_CHARS characters each; of a language that has longer texts
only, their first so many characters are fitted. Every text is scored whole.
Letters beyond the most frequent ones of the sample share a few symbols by their
place in Unicode, so that scripts stay apart.

The regression's best score can't tell a text of no learned language (the values
of the k languages always sum to 2 - k, so the best is never low). For that there
is coverage: the share of a text's distinct n-grams that the landmarks have and
that are of learned letters. Its floor is calibrated on the fitted rows that are
no landmarks.

Defined results: text null or without a letter: `und`, score 0. Without any
labelled text to learn from, all are `und`. Ties go to the first language in
alphabetical order.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import id_hash, resident

SAMPLE_DOCS = 2400
SAMPLE_CHARS = 8000
LANDMARKS = 128
RIDGE = 1e-3
#: Symbols: 0 any run without letters, 1 to OTHERS letters outside the alphabet by blocks of 128, the rest learned letters.
SYMBOLS, OTHERS = 64, 8
#: The floor of coverage: this part of this quantile of the fitted rows.
FLOOR_QUANTILE, FLOOR_PART = 0.01, 0.8
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
BATCH = 256
UNKNOWN = "und"


class Alphabet:
    """Text to distinct n-gram codes."""

    def __init__(self, letters: str):
        self.of = np.zeros(0x110000, np.uint8)
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.of[self.letter] = 1 + (np.flatnonzero(self.letter) >> 7) % OTHERS
        for n, c in enumerate(letters[: SYMBOLS - OTHERS - 1]):
            self.of[ord(c)] = n + OTHERS + 1
        self.flags = np.zeros(GRAMS, bool)

    def grams(self, text: str) -> np.ndarray:
        """Sorted codes; empty if the text has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.of[points].astype(np.int32)
        if not s.any():
            return np.zeros(0, np.int64)
        s = np.concatenate([[0], s, [0]])
        s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
        two = s[:-1] * SYMBOLS + s[1:]
        self.flags[s] = True
        self.flags[two + SYMBOLS] = True
        self.flags[two[:-1] * SYMBOLS + s[2:] + SYMBOLS + SYMBOLS**2] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


class Model:
    """Landmarks and weights. Small: LANDMARKS texts of bounded length."""

    def __init__(self, letters: str, langs: list[str], columns: np.ndarray, landmarks: np.ndarray, norms: np.ndarray, weights: np.ndarray, floor: float):
        self.letters, self.langs, self.columns, self.landmarks, self.norms, self.weights, self.floor = letters, langs, columns, landmarks, norms, weights, floor
        self.tag = uuid.uuid4().hex

    def scorer(self):
        alphabet = Alphabet(self.letters)
        column = np.full(GRAMS, -1, np.int64)
        column[self.columns] = np.arange(len(self.columns))
        matrix = np.ascontiguousarray(self.landmarks.T, np.float32)
        plain = learned(self.columns)

        def score(texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
            kernel, some, cover = kernels(texts, alphabet, column, matrix, self.norms, plain)
            values = kernel @ self.weights[:-1] + self.weights[-1]
            best = values.round(9).argmax(1)  # differences of the last digits are ties
            top = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
            return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, top, 0.0).tolist(), cover.tolist()

        return score


def learned(codes: np.ndarray) -> np.ndarray:
    """1 for n-grams without a letter outside the alphabet, else 0."""
    one, two, three = codes, codes - SYMBOLS, codes - SYMBOLS - SYMBOLS**2
    parts = [np.where(three >= 0, three // SYMBOLS**2, 0), np.where(three >= 0, three // SYMBOLS % SYMBOLS, np.where(two >= 0, two // SYMBOLS, 0)), np.where(three >= 0, three, np.where(two >= 0, two, one)) % SYMBOLS]
    return np.all([(p == 0) | (p > OTHERS) for p in parts], axis=0).astype(np.float32)


def kernels(texts, alphabet: Alphabet, column: np.ndarray, matrix: np.ndarray, norms: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised kernel of each text with each landmark; whether the text has letters; its coverage."""
    presence = np.zeros((len(texts), matrix.shape[0]), np.float32)
    size = np.ones(len(texts))
    some = np.zeros(len(texts), bool)
    for n, t in enumerate(texts):
        found = alphabet.grams(t) if t else ()
        if len(found):
            at = column[found]
            presence[n, at[at >= 0]] = 1
            size[n], some[n] = len(found), True
    return presence @ matrix / np.sqrt(size)[:, None] / np.sqrt(norms)[None, :], some, presence @ plain / size


def sample(docs: DataFrame, text: str, lang: str, doc_id: str, train: Column, size: int, chars: int) -> list:
    """Bounded: about size rows in all, an equal share for each language."""
    usable = docs.where(train & F.col(lang).isNotNull() & F.substring(text, 1, chars).rlike(r"\p{L}")).select(F.substring(text, 1, chars).alias("text"), (F.length(text) > chars).alias("long"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)).alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("all"), F.count_if(~F.col("long")).alias("short")).orderBy(F.desc("all"), "lang").limit(size // 8).collect()
    if not counts:
        return []
    share = size / len(counts)
    keep = F.lit(False)
    for row in counts:
        own, n = (F.col("lang") == row["lang"]) & (~F.col("long") | F.lit(row["short"] == 0)), row["short"] or row["all"]
        keep = keep | (own & (F.col("h") < int(min(1.0, share / n) * (1 << 30))))
    return usable.where(keep).orderBy("h", "text").limit(2 * size).collect()


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    rows = sample(docs, text, lang, doc_id, train, size, chars)
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    letters = Counter(c for r in rows for c in r["text"].lower() if c.isalpha())
    known = "".join(sorted(letters, key=lambda c: (-letters[c], c))[: SYMBOLS - OTHERS - 1])
    alphabet = Alphabet(known)
    each = max(1, landmarks // len(langs))
    marked = [n for g in langs for n in [n for n, x in enumerate(rows) if x["lang"] == g][:each]]
    chosen = [rows[n]["text"] for n in marked]
    grams = [alphabet.grams(t) for t in chosen]
    columns = np.unique(np.concatenate(grams))
    marks = np.zeros((len(chosen), len(columns)), np.float32)
    for n, g in enumerate(grams):
        marks[n, np.searchsorted(columns, g)] = 1
    norms = np.array([len(g) for g in grams], float)
    gram = (marks @ marks.T).astype(float) / np.sqrt(np.outer(norms, norms))
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    column = np.full(GRAMS, -1, np.int64)
    column[columns] = np.arange(len(columns))
    matrix = np.ascontiguousarray(marks.T)
    found = [kernels([r["text"] for r in rows[a : a + BATCH]], alphabet, column, matrix, norms, learned(columns)) for a in range(0, len(rows), BATCH)]
    kernel, cover = (np.concatenate([x[n] for x in found]) for n in (0, 2))
    others = np.delete(cover, marked)
    floor = FLOOR_PART * float(np.quantile(others, FLOOR_QUANTILE)) if len(others) else 0.0
    features = np.hstack([kernel @ root, np.ones((len(rows), 1))])
    goal = np.array([[1.0 if r["lang"] == g else -1.0 for g in langs] for r in rows])
    penalty = np.diag([ridge * len(rows)] * root.shape[1] + [0.0])
    solved = np.linalg.solve(features.T @ features + penalty + 1e-9 * np.eye(len(penalty)), features.T @ goal)
    return Model(known, langs, columns, marks, norms, np.vstack([root @ solved[:-1], solved[-1:]]), floor)


def scored(batches: Iterator[pa.RecordBatch], model: Model | None, text: str):
    """Each batch with its predictions, scores and coverages."""
    score = resident(("language-id", model.tag), model.scorer) if model else lambda texts: ([UNKNOWN] * len(texts), *([0.0] * len(texts) for _ in range(2)))
    for batch in batches:
        lang, value, cover = [], [], []
        for a in range(0, batch.num_rows, BATCH):
            got = score(batch.column(text).slice(a, BATCH).to_pylist())
            lang += got[0]
            value += got[1]
            cover += got[2]
        yield batch, lang, value, cover


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    need = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, value, _ in scored(batches, shared.value, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(value, pa.float64())], [*keep, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*need).mapInArrow(run, f"{kinds}lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose language is unknown, scored below `least` or covered below the model's floor."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lang, value, cover in scored(batches, shared.value, text):
            yield batch.filter(pa.array([g != UNKNOWN and v >= least and c >= shared.value.floor for g, v, c in zip(lang, value, cover)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return (id_hash(doc_id) % 3) == 1


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the others' text and lang."""
    model = fit(docs.select("doc_id", "text", "lang"), ~held_out())
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
