"""Text jobs over whole tables: chunking, spans, pooling, dataset checks, fuzzy joins."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import gcd
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.functions import text as tx
from mnemograph.operators import knn, ranking
from mnemograph.operators.ranking import first_rows
from mnemograph.sources import stores

#: Words of a chunk at most, words repeated from the chunk before; fixed values.
CHUNK_WORDS, OVERLAP_WORDS = 300, 50


class Unit(NamedTuple):
    """A paragraph, or a sentence of one that is too long to be a chunk."""

    body: str
    words: int
    place: int
    glue: str
    opens: bool


def text_units(text: str, size: int, separator: str) -> Iterator[Unit]:
    at = 0
    for body in filter(None, map(str.strip, text.split(separator))):
        at = text.find(body, at)
        words = len(body.split())
        if words <= size:
            yield Unit(body, words, at, separator, False)
            continue
        sentences = filter(None, map(str.strip, re.split(r"[.!?]+", body)))
        yield from (Unit(s, len(s.split()), at, " ", n == 0) for n, s in enumerate(sentences))


def chunk_text(text: str, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, separator: str = "\n\n") -> list[tuple[str, int, int]]:
    """(chunk, start, end): runs of units of up to `size` words.

    Runs are found on the running word totals. A run ends before a long paragraph. One
    that goes on inside a long paragraph begins with the last `overlap` words of the
    chunk before, and its offsets are counted back from that chunk's end.
    """
    units = list(text_units(text, size, separator))
    totals = [0, *accumulate(u.words for u in units)]
    stops = [*(n for n, u in enumerate(units) if u.opens), len(units)]
    out: list[tuple[str, int, int]] = []
    i = 0
    while i < len(units):
        unit = units[i]
        within = unit.glue == " " and bool(out) and not (unit.opens and unit.words <= size)
        lead = out[-1][0].split()[-overlap:] if within else []
        fits = bisect_right(totals, totals[i] + size - len(lead)) - 1
        j = min(max(i + 1, fits), stops[bisect_right(stops, i)])
        body = unit.body + "".join(u.glue + u.body for u in units[i + 1 : j])
        start = text.find(body, unit.place) if unit.words > size else unit.place
        if lead:
            start, body = out[-1][2] - len(" ".join(lead)), " ".join([*lead, body])
        out.append((body, start, start + len(body)))
        i = j
    return out


def chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS, separator: str = "\n\n") -> DataFrame:
    """(doc_id, chunk_no, text, start_idx, end_idx); sequential only within one document. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, *c) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for n, c in enumerate(chunk_text(t or "", size, overlap, separator))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "chunk_no", "text", "start_idx", "end_idx"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_no int, text string, start_idx int, end_idx int")


def entity_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, span_text, char_start, char_end, entity_type) of runs of capitalised words, by place."""
    pattern = re.compile(tx.spans_pattern())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, m.group(), m.start(), m.end()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if t for m in pattern.finditer(t)]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()))), pa.array(["CAPITALIZED_PHRASE"] * len(cols[0]), pa.string())], ["doc_id", "span_text", "char_start", "char_end", "entity_type"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, span_text string, char_start int, char_end int, entity_type string")


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, token_no, tok_start, tok_end) of the runs without white space in each text."""
    pattern = re.compile(r"\S+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                places = [m.span() for m in pattern.finditer(t or "")]
                if places:
                    a, b = zip(*places)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(a), pa.int64()), pa.array(range(len(a)), pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "token_no", "tok_start", "tok_end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, token_no int, tok_start int, tok_end int")


#: Characters of a bin of places; a token or span is in each bin that it touches.
BIN = 64


def overlaps(tokens: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Tokens joined to the spans of their text that they overlap. tokens(doc_id, token_no, tok_start, tok_end).

    By (text, bin of places), so that what meets is near: linear in tokens, spans and
    matches, however long a text. A pair that shares several bins counts in the first.
    """
    bins = lambda start, end: F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    t = tokens.where("tok_end > tok_start").withColumn("bin_", F.explode(bins("tok_start", "tok_end")))
    s = spans.where("char_end > char_start").withColumn("bin_", F.explode(bins("char_start", "char_end")))
    first = F.floor(F.greatest("tok_start", "char_start") / width)
    met = (F.col("tok_start") < F.col("char_end")) & (F.col("tok_end") > F.col("char_start")) & (F.col("bin_") == first)
    return t.join(s, ["doc_id", "bin_"]).where(met).drop("bin_")


def mean_pooled(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key, as a partial aggregate. vectors(keys, vec array<double>)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vectors.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean"), F.count("*").alias("n"))


#: Characters of a fingerprint, and the share of the longer text by which lengths may differ.
GRAM, LENGTH_GAP = 8, 0.1
#: Texts that have a fingerprint up to which it is expanded; texts with none rarer are found by whole hashes.
HOT = 50


def fuzzy_match(left: DataFrame, right: DataFrame, hot: int = HOT) -> DataFrame:
    """(lid, rid): equal after white space is squeezed; else one text contains the other and lengths differ by less than a tenth. The least right id. left(lid, text), right(rid, text).

    Texts that contain one another are found by winnowed fingerprints: the least hash of
    each window of character n-grams. All windows of the contained text are windows of the
    other, so any one of its fingerprints finds it: each text asks by the one that the
    fewest texts of the other side have. A text whose fingerprints are all in more than
    `hot` texts asks by a hash of the whole instead, among the parts of the others that
    have its length and the fingerprint at the same place.
    """
    a = stores.kept(left.where("text IS NOT NULL").select("lid", tx.squeezed(F.col("text")).alias("t")), "left")
    b = stores.kept(right.where("text IS NOT NULL").select("rid", tx.squeezed(F.col("text")).alias("t")).groupBy("t").agg(F.min("rid").alias("rid")), "right")
    equal = a.join(b, "t").select("lid", "rid")
    rest = a.join(b, "t", "left_anti")
    x = stores.kept(numbered_texts(rest.select("t").distinct()), "left-texts")
    y = stores.kept(numbered_texts(b.select("t")), "right-texts")
    pairs = contained(x, y, hot).union(contained(y, x, hot).select(F.col("large").alias("small"), F.col("small").alias("large")))
    best = pairs.distinct().join(y.select(F.col("n").alias("large"), "t"), "large").join(b, "t").groupBy("small").agg(F.min("rid").alias("rid"))
    found = best.join(x.select(F.col("n").alias("small"), "t"), "small")
    return equal.union(rest.join(found, "t").select("lid", "rid"))


def numbered_texts(texts: DataFrame) -> DataFrame:
    """(n, t) of texts with more than one character."""
    return texts.where(F.length("t") > 1).select(F.monotonically_increasing_id().alias("n"), "t")


def contained(small: DataFrame, large: DataFrame, hot: int) -> DataFrame:
    """(small, large): numbers of texts(n, t) where the first is in the second and not under nine tenths of its length."""
    marks = stores.kept(fingerprints(large, every=True), "marks")
    known = marks.groupBy("level", "mark").agg(F.count("*").alias("texts"))
    own = fingerprints(small, every=False).join(known, ["level", "mark"])
    rarest = stores.kept(own.groupBy("n").agg(F.min(F.struct("texts", "level", "mark")).alias("r")).select("n", "r.texts", "r.level", "r.mark"), "rarest")
    few = rarest.where(F.col("texts") <= hot).select(F.col("n").alias("small"), "level", "mark").join(marks.select(F.col("n").alias("large"), "level", "mark"), ["level", "mark"]).select("small", "large")
    many = anchored(large, asking(small.join(rarest.where(F.col("texts") > hot), "n")))
    both = few.union(many).distinct().join(small.select(F.col("n").alias("small"), F.col("t").alias("x")), "small").join(large.select(F.col("n").alias("large"), F.col("t").alias("y")), "large")
    return both.where(F.contains("y", F.col("x")) & (F.length("y") - F.length("x") < LENGTH_GAP * F.length("y"))).select("small", "large")


#: Base of the polynomial hash of a text's parts, modulo 2^64; pairs it finds are compared.
BASE = 0x9E3779B97F4A7C15 | 1
#: Asking texts of a file; hashes of parts that a task compares at once.
ASKING, COMPARED = 65_536, 1 << 20


def asking(texts: DataFrame) -> str:
    """The folder of (n, level, mark, place, size, whole) of texts(n, t, level, mark): where a text has its fingerprint first, its length and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t, level, mark in zip(*(batch.column(c).to_pylist() for c in ("t", "level", "mark"))):
                codes = code_points(t)
                found.append((int(np.argmax(gram_hashes(codes, gram_of(level)).view(np.int64) == mark)), len(codes), int(Parts(codes).hashes(np.array([0]), np.array([len(codes)])).view(np.int64)[0])))
            place, size, whole = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("n", "level", "mark")), pa.array(place, pa.int64()), pa.array(size, pa.int64()), pa.array(whole, pa.int64())], ["n", "level", "mark", "place", "size", "whole"])

    rows = texts.select("n", "t", "level", "mark").mapInArrow(run, "n long, level int, mark long, place long, size long, whole long")
    return knn.blocks(rows.orderBy("level", "mark", "size", "n"), ASKING)


def anchored(texts: DataFrame, path: str, compared=None) -> DataFrame:
    """(small, large): asking texts, files of asking(), in texts(n, t) of up to a tenth more characters, by the hash of the whole.

    Where a text has the asking one's fingerprint, the asking one can only begin at
    one place, so that its hash is held against one part of the text for each such
    place. A task goes through the files with each batch of its texts: nothing is
    shuffled but what is found. compared: an accumulator for the number of parts.
    """

    def packed(found: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        small = np.concatenate([x for x, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(small), pa.array(np.repeat([n for _, n in found], [len(x) for x, _ in found]))], ["small", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bodies = batch.column("n").to_pylist(), batch.column("t").to_pylist()
            marks = np.array([(k, *f) for k, t in enumerate(bodies) for f in winnowed(t, True)], np.int64).reshape(-1, 3)
            for table in knn.read_blocks(path):
                n, level, mark, place, size, whole = (np.asarray(table.column(c)) for c in ("n", "level", "mark", "place", "size", "whole"))
                at, last, found, held = marks[(marks[:, 1] >= level[0]) & (marks[:, 1] <= level[-1])], None, [], 0
                starts = np.flatnonzero(np.concatenate([[True], (np.diff(level) != 0) | (np.diff(mark) != 0)]))
                stops = {(int(level[a]), int(mark[a])): (a, b) for a, b in zip(starts, [*starts[1:], len(n)])}
                for k, *f in at.tolist():
                    if tuple(f) not in stops:
                        continue
                    a, b = stops[tuple(f)]
                    length = len(bodies[k])
                    a, b = a + np.searchsorted(size[a:b], int(length * (1 - LENGTH_GAP))), a + np.searchsorted(size[a:b], length, "right")
                    if a == b:
                        continue
                    if last != k:
                        last, codes = k, code_points(bodies[k])
                        parts = Parts(codes)
                    places = np.flatnonzero(gram_hashes(codes, gram_of(f[0])).view(np.int64) == f[1])
                    step = max(1, COMPARED // max(1, len(places)))
                    for x in range(a, b, step):
                        y = min(b, x + step)
                        begin = places[:, None] - place[None, x:y]
                        i, j = np.nonzero((begin >= 0) & (begin + size[None, x:y] <= length))
                        if compared is not None:
                            compared.add(len(i))
                        same = parts.hashes(begin[i, j], size[x + j]).view(np.int64) == whole[x + j]
                        hits = np.unique(n[x + j[same]])
                        if len(hits):
                            found.append((hits, own[k]))
                            held += len(hits)
                    if held >= COMPARED:
                        yield packed(found)
                        found, held = [], 0
                if found:
                    yield packed(found)

    return texts.select("n", "t").mapInArrow(run, "small long, large long")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Parts:
    """Hashes of a text's parts: h(c1..ck) = sum of c_i * BASE^(k - i), modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        inverse = pow(BASE, -1, 1 << 64)
        self.up = np.cumprod(np.full(len(codes), BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * np.cumprod(np.full(len(codes), inverse, np.uint64)))])

    def hashes(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[begin + size] - self.sums[begin]) * self.up[begin + size - 1]


def gram_of(level: int) -> int:
    return min(GRAM, 1 << (level - 1))


def gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Of each run of `gram` code points."""
    h = np.zeros(len(codes) - gram + 1, np.uint64)
    for k in range(gram):
        h = (h ^ codes[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnowed(text: str, every: bool) -> list[tuple[int, int]]:
    """(level, fingerprint) of a text: by its own length's power of two, or also as a text that contains one of the power below."""
    top = len(text).bit_length() - 1
    levels = [k for k in (top, top - 1) if k >= 1 and len(text) * (1 - LENGTH_GAP) < 2 ** (k + 1)] if every else [top]
    codes, out = code_points(text), []
    for level in levels:
        h = gram_hashes(codes, gram_of(level))
        for step in (1 << k for k in range(level - 1)):  # least of 2, 4, 8 ... neighbours
            h = np.minimum(h[:-step], h[step:])
        out += [(level, int(v)) for v in np.unique(h[: max(1, len(h))]).view(np.int64)]
    return out


def fingerprints(texts: DataFrame, every: bool) -> DataFrame:
    """(n, level, mark) of texts(n, t) of two characters and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, *f) for n, t in zip(batch.column("n").to_pylist(), batch.column("t").to_pylist()) for f in winnowed(t, every)]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], ["n", "level", "mark"])

    return texts.select("n", "t").mapInArrow(run, "n long, level int, mark long")


#: Characters of merged text in a row: what is longer goes on in further rows.
MERGED_CHARS = 1 << 28


def merged_by_first_line(passages: DataFrame, prefix: str = "Wikipedia Title: ", most: int = MERGED_CHARS) -> DataFrame:
    """(first_line, piece, merged) of passages(place, text): those with one first line are one text, their parts in order of place.

    A text of more than about `most` characters, as a first line that very many passages
    share may give, goes on in further pieces; piece 0 is all of any other.
    """
    d = first_line_parts(passages, prefix)
    before = F.sum(F.length("part")).over(Window.partitionBy("first_line").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / most))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"])
    return d.groupBy("first_line", "piece").agg(F.array_join(parts, "").alias("merged"))


def first_line_parts(passages: DataFrame, prefix: str = "Wikipedia Title: ") -> DataFrame:
    """(first_line, place, part) of passages(place, text): those with one first line are one text, whose parts follow by place.

    The first is whole, after the prefix; of the others there is what follows the first
    line, on a new line. The parts stay rows: no text of a common first line is gathered.
    """
    first = F.substring_index("text", "\n", 1)
    rest = F.regexp_replace(F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 1)"), r"^\n+|\n+$", "")
    d = passages.where("text IS NOT NULL").select(first.alias("first_line"), "place", "text", rest.alias("rest"))
    starts = d.groupBy("first_line").agg(F.min("place").alias("start"))
    part = F.when(F.col("place") == F.col("start"), F.concat(F.lit(prefix), "text")).otherwise(F.concat(F.lit("\n"), "rest"))
    return d.join(starts, "first_line").select("first_line", "place", part.alias("part"))


def dataset_checks(samples: DataFrame, size: int = 28, soft: bool = True) -> DataFrame:
    """Per target: what holds. samples(id, text, targets array<struct<span_text, char_start, char_end, soft_label, intensity>>)."""
    d = samples.select("id", "text", F.posexplode_outer("targets").alias("target_no", "t"))
    label = F.col("t.soft_label").cast("array<double>")
    total = F.aggregate(label, F.lit(0.0), lambda s, x: s + (x * x if soft else x))
    strength = F.sqrt(total) if soft else F.array_max(label)
    shape = F.lit(True) if soft else F.abs(total - 1) <= 0.01
    return d.where("t IS NOT NULL").select(
        "id", "target_no",
        ((F.col("t.char_start") >= 0) & (F.col("t.char_end") <= F.length("text")) & (F.col("t.char_start") < F.col("t.char_end"))).alias("bounds_ok"),
        (F.expr("substring(text, t.char_start + 1, t.char_end - t.char_start)") == F.col("t.span_text")).alias("span_ok"),
        (F.size(label) == size).alias("dims_ok"),
        (F.forall(label, lambda x: (x >= 0) & (x <= 1)) & shape).alias("range_ok"),
        (F.abs(F.col("t.intensity") - strength) <= 0.001).alias("intensity_ok"),
    )


def quality_score(checks: DataFrame) -> DataFrame:
    """Counts and a score from 0 to 5: the share of targets that pass each of the five checks, summed."""
    names = ["bounds_ok", "span_ok", "dims_ok", "range_ok", "intensity_ok"]
    return checks.agg(F.count("*").alias("targets"), F.countDistinct("id").alias("samples"), *(F.count_if(n).alias(n) for n in names), F.round(sum(F.avg(F.col(n).cast("double")) for n in names), 6).alias("score"))


def strides(n: int, most: int = 64) -> list[int]:
    """Steps that visit all of n places: coprime with n, spread over the range."""
    spread = (1 + int(n * 0.6180339887 * k) % n for k in range(1, 8 * most))
    return list(dict.fromkeys(s for s in spread if gcd(s, n) == 1))[:most] or [1]


def seeded_others(questions: DataFrame, ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(qid, id, place): n ids per question(qid, gold) other than its gold, without replacement, the same for the same seed; all others if there are fewer.

    The ids are numbered; a question starts at a place by hash and goes on by a stride
    that is coprime with their number, so its first n + 1 places are distinct. No pair of
    all questions and ids is formed.
    """
    placed = stores.kept(ranking.numbered(ids.select("id").distinct(), "id"), "numbered")
    total = placed.count()
    if not total:
        return questions.select("qid", F.lit(None).cast(ids.schema["id"].dataType).alias("id"), F.lit(0).alias("place")).limit(0)
    steps = strides(total)
    draw = lambda salt, size: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("qid")), F.lit(size))
    step = F.element_at(F.array(*map(F.lit, steps)), (draw(1, len(steps)) + 1).cast("int")).cast("long")
    places = F.transform(F.sequence(F.lit(0), F.lit(min(n, total - 1))), lambda k: F.pmod(draw(0, total) + k * step, F.lit(total)))
    d = questions.select("qid", "gold", F.posexplode(places).alias("draw", "place")).join(placed, "place").where(~F.col("id").eqNullSafe(F.col("gold")))
    w = Window.partitionBy("qid").orderBy("draw")  # n + 1 rows a question
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("qid", "id", "place")


def proportional_mix(main: DataFrame, other: DataFrame, share: float, *order: str) -> DataFrame:
    """All rows of main and as many of other, in the given order, as make `share` of the whole."""
    return main.unionByName(first_rows(other, int(main.count() * share / (1 - share)), *order))


def described(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, entity, description) of responses(id, response), entities(id, entity): what a line says of the entity.

    Lines `entity: ...` and `entity - ...`, the first that says something; else of the
    first line that names the entity, in any case, the first words; else empty.
    """
    lines = responses.select("id", F.posexplode(F.split("response", "\n")).alias("n", "line")).select("id", "n", F.trim("line").alias("line"))
    d = entities.join(lines, "id").where(F.contains(F.lower("line"), F.lower("entity")))
    after = lambda mark: F.when(F.instr(F.col("line"), F.concat("entity", F.lit(mark))) > 0, F.expr(f"substring(line, instr(line, concat(entity, '{mark}')) + length(entity) + {len(mark)})"))
    said = F.nullif(tx.description(F.coalesce(after(":"), after(" -"))), F.lit(""))
    loose = F.nullif(tx.loose_description(F.col("line")), F.lit(""))
    found = d.select("id", "entity", "n", said.alias("said"), loose.alias("loose")).groupBy("id", "entity").agg(F.min_by("said", F.when(F.col("said").isNotNull(), F.col("n"))).alias("said"), F.min_by("loose", F.when(F.col("loose").isNotNull(), F.col("n"))).alias("loose"))
    return entities.join(found, ["id", "entity"], "left").select("id", "entity", F.coalesce("said", "loose", F.lit("")).alias("description"))


def prompts(passages: DataFrame, k: int = 5, mark: str = "|") -> DataFrame:
    """(qid, prompt): a question's best k passages in order and the question. passages(qid, question, rank, text)."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), mark)  # k rows a question
    return passages.where(F.col("rank") <= k).groupBy("qid", "question").agg(F.concat(parts, F.lit(f"{mark}Question: "), F.col("question")).alias("prompt"))


def gold_by_title(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, gold) of nested(question, facts array<struct<title, i>>, context array<struct<title, sentences>>).

    corpus(title, text), one row per title; gold(question, title) of the facts whose title is in the context.
    """
    c = nested.select("question", F.explode("context").alias("c")).select("question", "c.title", F.array_join("c.sentences", " ").alias("text"))
    named = lambda column, fact: F.transform(column, lambda x: F.struct(x["title"].alias("title"), F.lit(fact).alias("fact")))
    both = F.flatten(F.array_compact(F.array(named("context", False), named("facts", True))))  # a row is opened once, for both
    g = nested.where("question IS NOT NULL").select("question", F.explode(both).alias("g")).select("question", "g.title", "g.fact").where("title IS NOT NULL")
    g = g.groupBy("question", "title").agg(F.bool_or("fact").alias("named"), F.bool_or(~F.col("fact")).alias("there"))
    return c.groupBy("title").agg(F.min("text").alias("text")), g.where("named AND there").select("question", "title")


def keyed_spans(docs: DataFrame, most: int = 10, context: int = 100) -> DataFrame:
    """(doc_id, text, span_text, char_start, char_end, label_key) of the cleaned texts: their first spans, each with the key of its label, a hash of span and context."""
    d = docs.select("doc_id", tx.cleaned(F.col("text")).alias("text")).where("text IS NOT NULL")
    w = Window.partitionBy("doc_id").orderBy("char_start")
    s = entity_spans(d).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).join(d, "doc_id")
    key = F.md5(F.concat("span_text", F.lit("|"), F.substring("text", 1, context)).cast("binary"))
    return s.select("doc_id", "text", "span_text", "char_start", "char_end", key.alias("label_key"))


def labelled_samples(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, targets array<struct<char_start, char_end, span_text, soft_label, intensity>>) of keyed_spans() and labels(label_key, soft_label).

    Spans without a label go, and texts without targets; the intensity is the label's length.
    """
    d = spans.join(labels.select("label_key", "soft_label").dropDuplicates(["label_key"]), "label_key")
    size = F.sqrt(F.aggregate("soft_label", F.lit(0.0), lambda s, x: s + x * x))
    target = F.struct("char_start", "char_end", "span_text", "soft_label", size.alias("intensity"))
    targets = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(target)).alias("targets"))  # a few of one text
    return targets.join(spans.select("doc_id", "text").dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "text", "targets")


def closest_strings(facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(fact_id, match): per fact the candidate of its own short list with the least edit distance; ties by text. candidates(fact_id, candidate)."""
    d = facts.join(candidates, "fact_id")
    return d.groupBy("fact_id").agg(F.min(F.struct(F.levenshtein("fact", "candidate").alias("d"), F.col("candidate").alias("c")))["c"].alias("match"))
