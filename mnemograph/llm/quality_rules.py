"""Quality rules as a learned decision list, in DataFrame operations only.

Each text gets its statistics from built-in functions. Two base rules reject
short and repetitive texts. For the others a decision list is learned from
labelled rows by sequential covering: a rule (a conjunction of thresholds) is
grown on two thirds of the rows not yet covered, one condition at a time by
information gain, pruned on the last third, and kept if it is precise there; the
rows it covers leave, and the next rule is sought. Each step is one aggregation
over the labelled statistics that gives counts per statistic and threshold (a few
hundred numbers). The list becomes one ordered conditional expression.

A statistic of its own counts words of a lexicon that labels single out: words
nearly absent from rows that aren't toxic, and in so many toxic rows that not one
of all the words tested would be there by chance (an error of CHANCE for the whole
lexicon). Copies of one text are no independent witnesses: of rows with an equal
least window hash, by any of COPY_MARKS hash functions, one counts. The lexicon is
learned from the growing rows alone, so that the pruning rows are
an honest test of it. Lexicon and list are fitted on a bounded sample of the
labelled rows (SAMPLE, by kind), drawn by a hash of the id; within it every word is
tested and every word that passes is kept. Up to LITERAL_WORDS words are matched in
place, more by a join.

Defined results: a null or empty text has no words and fails the base rules.
Without labels, no rule is learned. If an id is labelled more than once, the
worst label holds. Of conditions with equal gain the first statistic's lowest
threshold is taken, of equally good beginnings of a rule the shortest. Repeated
rows are judged each.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.llm.common import stored, unused

SPACE = r"[ \t-\r]"
#: Labelled rows that the rules and the lexicon are fitted on, at most about, by kind.
SAMPLE = {"toxic": 8000, "bad": 6000, "good": 10_000}
#: Thresholds per statistic at most.
THRESHOLDS = 24
#: Rules of the list, conditions of a rule, precision on pruning rows, rows covered there.
MOST_RULES, MOST_CONDITIONS, PRECISION, LEAST_COVER = 12, 4, 0.9, 4
#: The lexicon: labelled toxic rows and share of a word's rows that are toxic at least; the chance that it has a word by accident.
LEXICON_ROWS, LEXICON_SHARE, CHANCE = 4, 0.98, 0.01
#: Hash functions over five-word windows that tell copies among the lexicon's rows.
COPY_MARKS = 4
#: Words up to which the lexicon is a list in the plan; a larger one stays a table.
LITERAL_WORDS = 5000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_shouts", "n_flagged")


def letters(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def left(text: Column, kept: str) -> Column:
    """Number of characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def flagged_counts(docs: DataFrame, text: str, lexicon: DataFrame, name: str) -> DataFrame:
    """docs with the number of lexicon words of each text, by joins. lexicon(word), distinct."""
    key = unused(docs, "text_key_")
    d = docs.withColumn(key, F.md5(F.col(text).cast("binary")))
    once = d.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).dropDuplicates(["k"])
    found = once.select("k", F.explode(letters(F.col("t"))).alias("word")).join(lexicon, "word").groupBy("k").agg(F.count("*").alias(name))
    return d.join(found.withColumnRenamed("k", key), key, "left").drop(key)


def measured(docs: DataFrame, text: str, lexicon: list[str] | DataFrame, name: str) -> DataFrame:
    """docs with a struct column `name` of counts. No Python; no shuffle unless the lexicon is a table."""
    columns, joined = docs.columns, isinstance(lexicon, DataFrame)
    hits = unused(docs, "hits_")
    if joined:
        docs = flagged_counts(docs, text, lexicon, hits)
    words = unused(docs, "words_")
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn(words, F.array_remove(F.split(t, SPACE + "+"), ""))
    n = F.size(words)
    w = F.col(words)
    # hash and place of each 3-word window, sorted: equal windows become neighbours
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("p")))
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    some = unused(docs, "some_")
    d = d.withColumn(some, F.when(n >= 4, F.size(F.array_distinct(hashes)) < n - 2).otherwise(False))
    order = unused(docs, "order_")
    d = d.withColumn(order, F.when(F.col(some), F.array_sort(grams)))
    o, m = F.col(order), F.size(order)
    twice = F.zip_with(F.slice(o, 1, m - 1), F.slice(o, 2, m - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")))
    places = F.array_distinct(F.flatten(F.transform(F.flatten(twice), lambda p: F.array(p, p + 1, p + 2))))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    flagged = F.col(hits) if joined else F.size(F.filter(letters(t), lambda x: x.isin(lexicon))) if lexicon else F.lit(0)
    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        left(t, r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col(some), F.size(places)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        left(t, r"\p{Lu}").cast("long").alias("n_upper"),
        left(t, "0-9").cast("long").alias("n_digits"),
        left(t, "!").cast("long").alias("n_shouts"),
        F.coalesce(flagged, F.lit(0)).cast("long").alias("n_flagged"),
        # a non-deterministic field keeps the optimizer from copying the counts into each later use and filter
        F.monotonically_increasing_id().alias("row"),
    )
    return d.withColumn(name, counts).select(*columns, name)


def statistics(at: str = "") -> dict[str, Column]:
    """What rules may test, over the counts in the struct named by `at`; 0 where undefined."""
    c = {n: F.col(at + n) for n in COUNTS}
    found = {
        "words": c["n_words"],
        "word_length": F.try_divide(c["word_chars"], c["n_words"]),
        "symbol_rate": F.try_divide(c["n_symbols"], c["n_words"]),
        "dup_line_rate": F.try_divide(c["n_dup_lines"], c["n_lines"]),
        "repeat_rate": F.try_divide(c["n_repeat_words"], c["n_words"]),
        "upper_rate": F.try_divide(c["n_upper"], c["word_chars"]),
        "digit_rate": F.try_divide(c["n_digits"], c["word_chars"]),
        "shout_rate": F.try_divide(c["n_shouts"], c["n_words"]),
        "flagged": c["n_flagged"],
        "flagged_rate": F.try_divide(c["n_flagged"], c["n_words"]),
    }
    return {n: F.coalesce(x.cast("double"), F.lit(0.0)) for n, x in found.items()}


def base_failed(at: str = "") -> Column:
    n, r = F.col(at + "n_words"), F.col(at + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def sampled(labels: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(id, toxic, bad, weight) of about sizes[kind] labelled ids of each kind: toxic, else bad, else good. Bounded, drawn by a hash."""
    worst = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"), F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad")
    )
    worst = worst.withColumn("kind", F.when(F.col("toxic"), "toxic").when(F.col("bad"), "bad").otherwise("good"))
    share = {r["kind"]: min(1.0, sizes[r["kind"]] / r["count"]) for r in worst.groupBy("kind").count().collect()}  # three rows
    drawn, weight = F.lit(False), F.lit(1.0)
    for kind, part in share.items():
        own = F.col("kind") == kind
        drawn, weight = drawn | (own & (F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30)))), F.when(own, 1 / part).otherwise(weight)
    return worst.where(drawn).select("id", "toxic", "bad", weight.alias("weight")).limit(2 * sum(sizes.values()))


def without_copies(rows: DataFrame) -> DataFrame:
    """rows of a bounded sample (id, text, toxic, ...) with one of each group that shares a least window hash: of the least id."""
    w = F.array_remove(F.split(F.lower("text"), SPACE + "+"), "")
    d = rows.select("id", "toxic", "text", w.alias("w"))

    def mark(seed: int) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.lit(seed), *(F.element_at("w", i + k) for k in range(5))))
        return F.when(F.size("w") >= 5, F.array_min(windows)).otherwise(F.xxhash64("text")).alias(f"m{seed}")

    names = [f"m{k}" for k in range(COPY_MARKS)]
    left = stored(d.select("id", "toxic", *map(mark, range(COPY_MARKS))), "copy-marks")
    for name in names:
        left = left.groupBy("toxic", name).agg(F.min(F.struct("id", *(n for n in names if n != name))).alias("x")).select("toxic", name, "x.*")
    return rows.join(F.broadcast(left.select("id")), "id", "left_semi")


def learn_lexicon(rows: DataFrame) -> list[str] | DataFrame:
    """All words nearly all of whose rows are toxic and that are in too many toxic rows for chance; a table (word) if over LITERAL_WORDS.

    A word that has nothing to do with toxicity is in toxic rows alone with the
    chance p^n for n rows, p being the share of toxic ones; n must be so large that
    this, times the number of words tested, is at most CHANCE.
    """
    rows = without_copies(rows)
    total, toxic = rows.agg(F.count("*"), F.count_if("toxic")).first()
    words = rows.select(F.explode(F.array_distinct(letters(F.col("text")))).alias("word"), "toxic", "weight").where("word != ''")
    counted = words.groupBy("word").agg(F.count_if("toxic").alias("n"), F.sum(F.when(F.col("toxic"), F.col("weight"))).alias("bad"), F.sum("weight").alias("all"))
    counted = stored(counted.where(F.col("n") >= LEXICON_ROWS), "toxic-words")
    tested = counted.count()
    if not tested or toxic == total:
        return []
    least = max(LEXICON_ROWS, log(tested / CHANCE) / log(total / toxic))
    found = stored(counted.where((F.col("n") >= least) & (F.col("bad") >= LEXICON_SHARE * F.col("all"))).select("word"), "lexicon")
    few = [r["word"] for r in found.limit(LITERAL_WORDS + 1).collect()]
    return sorted(few) if len(few) <= LITERAL_WORDS else found


def for_pruning() -> Column:
    """A third of the labelled rows, by a hash of the id."""
    return F.pmod(F.xxhash64("id"), F.lit(3)) == 2


class Learner:
    """Sequential covering over a stored table (id hash third, bad, one bin per statistic)."""

    def __init__(self, rows: DataFrame):
        names = list(statistics())
        values = rows.select(for_pruning().alias("prune"), "bad", "weight", *(c.alias(n) for n, c in statistics().items()))
        points = [i / (THRESHOLDS - 1) for i in range(THRESHOLDS)]
        both = [F.percentile_approx(F.when(c, F.col(n)), points, 2000).alias(f"{n}_{k}") for n in names for k, c in (("all", F.lit(True)), ("bad", F.col("bad")))]
        cuts = values.agg(*both).first()
        self.cuts = {n: sorted({round(x, 6) for k in ("all", "bad") for x in (cuts[f"{n}_{k}"] or []) if x > 0} | {1e-6}) for n in names}
        bins = [sum(((F.col(n) >= cut).cast("int") for cut in self.cuts[n]), F.lit(0)).alias(n) for n in names]
        self.rows = stored(values.select("prune", "bad", "weight", *bins), "binned")
        self.names = names

    def where(self, rule: list[tuple[str, str, int]]) -> Column:
        found = F.lit(True)
        for name, way, cut in rule:
            found = found & (F.col(name) >= cut if way == ">=" else F.col(name) < cut)
        return found

    def histograms(self, rows: DataFrame) -> dict[str, np.ndarray]:
        """By statistic: weight of the rows by bin and label (0 good, 1 bad)."""
        pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in self.names)))
        out = {n: np.zeros((len(self.cuts[n]) + 1, 2)) for n in self.names}
        for r in rows.select(pairs.alias("x"), "bad", "weight").groupBy("x.name", "x.bin", "bad").agg(F.sum("weight").alias("w")).collect():
            out[r["name"]][r["bin"], int(r["bad"])] += r["w"]
        return out

    def grow(self, rows: DataFrame) -> list[tuple[str, str, int]]:
        rule: list[tuple[str, str, int]] = []
        while len(rule) < MOST_CONDITIONS:
            best, gain = None, 1e-9
            for name, h in self.histograms(rows.where(self.where(rule))).items():
                total = h.sum(0)
                if not total[1] or not total[0]:
                    break
                now = np.log2(total[1] / total.sum())
                over = h[::-1].cumsum(0)[::-1]
                for way, side in ((">=", over), ("<", total - over)):
                    for cut in range(1, len(h)):
                        good, bad = side[cut]
                        if bad and (g := bad * (np.log2(bad / (bad + good)) - now)) > gain:
                            best, gain = (name, way, cut), g
            if best is None:
                break
            rule.append(best)
        return rule

    def prune(self, rows: DataFrame, rule: list) -> tuple[list, float, float]:
        """The best beginning of the rule on the pruning rows, with its bad and good weight there."""
        ends = range(1, len(rule) + 1)
        got = rows.agg(*(F.coalesce(F.sum(F.when(self.where(rule[:k]) & (F.col("bad") == b), F.col("weight"))), F.lit(0.0)).alias(f"c{k}{int(b)}") for k in ends for b in (True, False))).first()
        value = {k: (got[f"c{k}1"], got[f"c{k}0"]) for k in ends}
        k = max(ends, key=lambda k: ((value[k][0] - value[k][1]) / max(1, sum(value[k])), -k))
        return rule[:k], *value[k]

    def rules(self) -> list[list[tuple[str, str, float]]]:
        found, left = [], self.rows
        while len(found) < MOST_RULES:
            rule = self.grow(left.where("NOT prune"))
            if not rule:
                break
            rule, bad, good = self.prune(left.where("prune"), rule)
            if bad < LEAST_COVER or bad < PRECISION * (bad + good):
                break
            left = left.where(~self.where(rule))
            found.append([(name, way, self.cuts[name][cut - 1]) for name, way, cut in rule])
        return found


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sizes: dict[str, int] = SAMPLE) -> tuple[list[str] | DataFrame, list]:
    """(lexicon, rules) from a bounded sample of the rows of docs that labels name."""
    few = stored(sampled(labels, sizes), "labels")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(few), "id")
    rows = stored(rows, "labelled")
    lexicon = learn_lexicon(rows.where(~for_pruning()))
    counted = stored(measured(rows, "text", lexicon, "m").select("id", "bad", "weight", "m.*"), "statistics").where(~base_failed())
    return lexicon, [] if counted.where("bad").isEmpty() else Learner(counted).rules()


def verdict(rules: list, at: str = "") -> Column:
    """The list as one ordered conditional expression: false where a rule rejects."""
    values = statistics(at)
    out = F.when(base_failed(at), False)
    for rule in rules:
        met = F.lit(True)
        for name, way, cut in rule:
            met = met & (values[name] >= cut if way == ">=" else values[name] < cut)
        out = out.when(met, False)
    return out.otherwise(True)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each row."""
    lexicon, rules = learn(docs, labels)
    m = measured(docs.select("doc_id", "text"), "text", lexicon, "m")
    return m.select("doc_id", *(F.col("m." + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed("m.").alias("base_failed"), verdict(rules, "m.").alias("kept"))


def kept(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that the base rules or the learned list reject."""
    lexicon, rules = learn(docs, labels, doc_id, text)
    name = unused(docs, "counts_")
    return measured(docs, text, lexicon, name).where(verdict(rules, name + ".")).select(docs.columns)
