"""Column expressions over text: ids, normal forms, rule entities, response parsing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Capitalised words that are no entities; fixed values.
ENTITY_STOP_WORDS = ["The", "A", "An", "And", "Or", "But", "In", "On", "At", "To", "For", "Of", "With", "By", "From", "As", "Is", "Was", "Are"]
#: Words that the second rule set drops, in any case; fixed values.
PATTERN_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "are"]
#: Titles; fixed values.
TITLES = ["Count", "Duke", "King", "Queen", "Prince", "Princess", "Sir", "Madame", "Mr", "Mrs", "Ms", "Dr"]
#: Signs of a failed answer; fixed values.
ERROR_WORDS = ["出错", "Error", "error", "HTTPSConnectionPool", "ConnectionError", "Timeout"]
#: Labels of an emotion vector, in order; fixed values.
EMOTIONS = [
    "admiration", "amusement", "approval", "caring", "desire", "excitement", "gratitude", "joy", "love", "optimism", "pride", "relief",
    "anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness",
    "confusion", "curiosity", "realization", "surprise", "neutral",
]
#: Categories of the lexicon classifier; fixed values.
CATEGORIES = ["neutral", "joy", "sadness", "anger", "fear", "surprise", "disgust", "love", "hate", "interest"]
#: Category of each word of the lexicon classifier; fixed values. Words of other categories count nowhere.
LEXICON = {
    "joy": "joy", "happiness": "joy", "happy": "joy", "excited": "joy", "enthusiasm": "joy", "cheerful": "joy", "delight": "joy", "elated": "joy",
    "sadness": "sadness", "sad": "sadness", "sorrow": "sadness", "grief": "sadness", "melancholy": "sadness", "depressed": "sadness",
    "anger": "anger", "angry": "anger", "rage": "anger", "furious": "anger", "irritated": "anger", "annoyed": "anger", "frustrated": "anger",
    "fear": "fear", "afraid": "fear", "terrified": "fear", "anxious": "fear", "worried": "fear", "nervous": "fear", "scared": "fear",
    "surprise": "surprise", "surprised": "surprise", "amazed": "surprise", "shocked": "surprise", "astonished": "surprise",
    "disgust": "disgust", "disgusted": "disgust", "revolted": "disgust", "repulsed": "disgust",
    "love": "love", "affection": "love", "tenderness": "love", "warmth": "love", "fondness": "love", "adoring": "love",
    "hate": "hate", "hatred": "hate", "contempt": "hate", "loathing": "hate", "dislike": "hate",
    "interest": "interest", "curiosity": "interest", "intrigue": "interest", "engaged": "interest", "fascinated": "interest",
    "calm": "neutral", "peaceful": "neutral", "serene": "neutral", "relaxed": "neutral", "tranquil": "neutral",
    "tense": "fear", "stressed": "fear", "uneasy": "fear", "restless": "fear",
    "hope": "joy", "hopeful": "joy", "optimistic": "joy", "expectant": "interest",
    "despair": "sadness", "hopeless": "sadness", "pessimistic": "sadness", "desperate": "sadness",
}
#: Words that no description consists of; fixed values.
FILLERS = ["the", "and", "for", "are"]
#: A chapter heading, and a run of capitalised words; fixed values.
CHAPTER = r"(?i)(?U)\bChapter\s+\d+"
CAPITALISED = r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){%s}\b"
SPACE_RUN = r"(?U)\s+"
#: Nesting of brackets that a cut-off JSON answer may have.
JSON_DEPTH = 8


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: expressions inside lambdas and branches are not shared by Spark."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_id(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.md5(text.cast("binary")))


def normalised(text: Column) -> Column:
    """Lower case; anything but ASCII letters, digits and spaces becomes a space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]", " "))


def answer_normalised(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?:(?<![0-9A-Za-z_]))(?:a|an|the)(?![0-9A-Za-z_])", " "), r"\s+", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]\s*| \s+", " "))  # single spaces stay as they are


def entities_normalised(names: Column) -> Column:
    """Names trimmed and squeezed; empty ones go, and of equal ones the first stays."""
    return F.array_distinct(F.filter(F.transform(names, squeezed), lambda n: n != ""))


def valid_answer(text: Column) -> Column:
    bad = F.lit(False)
    for word in ERROR_WORDS:
        bad = bad | F.contains(text, F.lit(word))
    return F.coalesce((text != "") & ~bad, F.lit(False))


def chapter_title(text: Column) -> Column:
    t = F.trim(text)
    return ((F.length(t) < 50) & t.rlike(CHAPTER)) | ((F.size(F.split(t, "\n")) <= 2) & F.exists(F.split(t, "\n"), lambda x: x.rlike(CHAPTER)))


def cleaned(text: Column) -> Column:
    """Without leading chapter lines; null for titles and texts under 10 characters."""
    t = F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    lines = F.split(t, "\n")
    first = F.array_position(F.transform(lines, lambda x: (~x.rlike(CHAPTER)).cast("int")), 1)
    kept = F.trim(F.array_join(F.when(first > 0, F.slice(lines, first.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>")), "\n"))
    return F.when((F.length(t) >= 10) & ~chapter_title(t) & (F.length(kept) >= 10), kept)


def by_place(found: Column, text: Column) -> Column:
    """Distinct strings in order of their first place in the text; ties by string."""
    placed = F.transform(F.array_distinct(found), lambda e: F.struct(F.position(e, text).alias("p"), e.alias("e")))
    return F.transform(F.array_sort(placed), lambda s: s["e"])


def rule_entities(text: Column) -> Column:
    """Capitalised runs, quoted phrases and their words, titles; minus stop words; by first place."""
    names = F.regexp_extract_all(text, F.lit(CAPITALISED % "0,"), F.lit(0))
    phrases = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    words = F.flatten(F.transform(phrases, lambda p: F.array_remove(F.split(p, SPACE_RUN), "")))
    several = F.filter(phrases, lambda p: F.size(F.array_remove(F.split(p, SPACE_RUN), "")) > 1)
    titles = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?U)\b({'|'.join(TITLES)})\b"), F.lit(1)), F.initcap)
    return F.array_distinct(F.transform(by_place(F.array_except(F.concat(names, several, words, titles), F.array(*map(F.lit, ENTITY_STOP_WORDS))), text), squeezed))


def pattern_entities(text: Column, most: int = 20, shortest: int = 2) -> Column:
    """Capitalised words, runs of two and more, runs of up to four, and quoted text; minus stop words in any case; the first by place, ties by string."""
    runs = [F.regexp_extract_all(text, F.lit(CAPITALISED % times), F.lit(0)) for times in ("0", "1,", "1,3")]
    quoted = F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1))
    found = F.transform(F.concat(*runs, quoted), lambda e: F.regexp_replace(e, r"(?U)^\s+|\s+$", ""))
    kept = F.filter(found, lambda e: (F.length(e) >= shortest) & ~F.lower(e).isin(PATTERN_STOP_WORDS))
    return F.slice(by_place(kept, text), 1, most)


def spans_pattern() -> str:
    """Two or more capitalised words."""
    return (CAPITALISED % "1,").removeprefix("(?U)")


def emotion_words() -> list[tuple[str, str]]:
    return list(LEXICON.items())


def emotion_shares(text: Column) -> Column:
    """Map category to share of lexicon words; neutral 1 without any; all 0 for blank text. The words are found once."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: w.isin(list(LEXICON)))
    blank = F.coalesce(F.trim(text) == "", F.lit(True))

    def shares(found: Column) -> Column:
        def named(category: str) -> Column:
            return F.size(F.filter(found, lambda w: w.isin([w for w, c in LEXICON.items() if c == category])))

        share = lambda c: F.when(blank, 0.0).when(F.size(found) == 0, 1.0 if c == "neutral" else 0.0).otherwise(F.try_divide(named(c), F.size(found)))
        return F.create_map(*(x for c in CATEGORIES for x in (F.lit(c), share(c))))

    return bound(words, shares)


def intensity(shares: Column) -> Column:
    return F.array_max(F.map_values(F.map_filter(shares, lambda c, _: c != "neutral")))


def emotion_vector(response: Column) -> Column:
    """Unit vector of the scores in a model's response: JSON, else name by name; uniform where all are 0. The response is parsed once."""
    text = F.regexp_extract(response, r"\{[^{}]*\}", 0)
    parsed = F.from_json(F.when(text != "", text).otherwise(response), "map<string,double>")
    by_name = lambda e: F.nullif(F.regexp_extract(response, rf'"{e}"\s*:\s*(-?[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?)', 1), F.lit("")).cast("double")
    raw = bound(parsed, lambda found: F.array(*(F.coalesce(F.when(found.isNotNull(), found[e]).otherwise(by_name(e)), F.lit(0.0)) for e in EMOTIONS)))
    even = F.array_repeat(F.lit(1.0 / len(EMOTIONS)), len(EMOTIONS))
    unit = lambda v, size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(even)
    return bound(raw, lambda v: bound(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda size: unit(v, size)))


def answer_after_marker(text: Column, marker: str = "Answer:") -> Column:
    return F.trim(F.when(F.instr(text, marker) > 0, F.substring_index(text, marker, -1)).otherwise(text))


def json_repaired(json: Column) -> Column:
    """A cut-off JSON text without what follows its last comma, closed by the brackets that are still open there."""
    cut = F.when(F.instr(json, ",") > 0, F.regexp_extract(json, r"(?s)^(.*),", 1)).otherwise(json)
    open_ = F.regexp_replace(F.regexp_replace(cut, r'(?s)"(?:\\.|[^"\\])*(?:"|$)', ""), r"[^\[\]{}]", "")
    for _ in range(JSON_DEPTH):  # each turn takes away the innermost closed pairs
        open_ = F.regexp_replace(open_, r"\[\]|\{\}", "")
    return F.concat(cut, F.reverse(F.translate(open_, "[{", "]}")))


def json_field(response: Column, name: str, kind: str) -> Column:
    """Field `name` of the first object in a model's answer, repaired if it was cut short; null if there is none."""
    whole, rest = F.regexp_extract(response, r"(?s)\{.*\}", 0), F.regexp_extract(response, r"(?s)\{.*", 0)
    read = lambda text: F.from_json(text, f"`{name}` {kind}")[name]
    return F.coalesce(read(F.nullif(whole, F.lit(""))), read(json_repaired(F.nullif(rest, F.lit("")))))


def named_entities(response: Column) -> Column:
    """Distinct entity names of an answer, in order; empty without any."""
    found = F.coalesce(json_field(response, "named_entities", "array<string>"), F.array().cast("array<string>"))
    return F.array_distinct(F.array_compact(found))


def triples(response: Column) -> Column:
    """Distinct triples of an answer, in order; only those of three parts."""
    found = F.coalesce(json_field(response, "triples", "array<array<string>>"), F.array().cast("array<array<string>>"))
    return F.array_distinct(F.filter(found, lambda t: (F.size(t) == 3) & ~F.exists(t, lambda x: x.isNull())))


def description(rest: Column) -> Column:
    """What follows an entity's name, without numbering and outer punctuation."""
    return F.regexp_replace(F.regexp_replace(F.trim(rest), r"^\d+[.)]\s*", ""), r"^[,.:\-; ]+|[,.:\-; ]+$", "")


def loose_description(line: Column, words: int = 8) -> Column:
    """The first words of a line that say something, joined by commas."""
    bare = F.transform(F.split(line, SPACE_RUN), lambda w: F.regexp_replace(w, r"^[,.:\-;]+|[,.:\-;]+$", ""))
    kept = F.filter(bare, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(FILLERS))
    return F.array_join(F.slice(kept, 1, words), ", ")
