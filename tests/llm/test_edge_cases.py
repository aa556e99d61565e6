"""Every operator on one table of hard cases: null ids, clashing columns, very long texts, ties, repeated rows; and on none."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from mnemograph.llm import binary_ids, byte_bpe, common, decontaminate, fill_in_middle, language_id, language_model, near_dedup, quality_rules, sharding, source_divergence, streaming_bpe, token_counts, url_rules

RND = random.Random(21)
LONG = " ".join(RND.choice(["the", "of", "word", "ing"]) + str(RND.randrange(3000)) for _ in range(60_000))
TEXTS = [None, "", " \n\t ", "a", "same words here " * 30, "same words here " * 30, LONG, LONG, LONG + " tail", "x" * 200_000, "é" * 3000 + " 日本", "퟿\U0010ffff ok"]
CLASH = ["key", "n", "ids", "hits", "score", "text_key_", "node_key", "words_", "bands", "row", "token", "accepted", "held_out", "n_tokens"]
BPE, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if n in (0, 4, 6) else n, t, ["en", "de", None][n % 3]) for n, t in enumerate(TEXTS)] + [(3, "a", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return d.withColumns({c: F.lit(f"clash {c}") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(LONG.split()[100:140])), (None, "same words here"), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 0, 1), (3, 1, 0), (None, 0, 0), (7, None, None), (10, 1, 0)], "doc_id long, quality int, toxic int")


REPORTS = {
    "op1": lambda d, i, b: decontaminate.report(d, i),
    "op3": lambda d, i, b: language_id.report(d),
    "op4": lambda d, i, b: token_counts.count_tokens(d, BPE),
    "op5": lambda d, i, b: sharding.assign(d, limit=100_000),
    "op6": lambda d, i, b: language_model.report(d),
    "op7": lambda d, i, b: binary_ids.round_trip(d, WORDS),
    "op8": lambda d, i, b: quality_rules.report(d, b),
    "op9": lambda d, i, b: near_dedup.report(d),
    "op10": lambda d, i, b: byte_bpe.digest(d, RANKS),
    "op11": lambda d, i, b: fill_in_middle.digests(d),
    "op12": lambda d, i, b: streaming_bpe.digest(d, WORDS),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(docs, items, labels, name):
    """One row for each row with its id, equal rows alike, and nothing from nothing."""
    got = REPORTS[name](docs, items, labels)
    rows = got.collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in docs.select("doc_id").collect())
    twice = [tuple(v for c, v in r.asDict().items() if c != "start") for r in rows if r["doc_id"] == 3]
    assert len(twice) == 2 and twice[0] == twice[1]
    empty = REPORTS[name](docs.limit(0), items.limit(0), labels.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_tables_keep_their_columns(docs, items, labels):
    """What filters or adds a column keeps all others as they are."""
    model = language_id.fit(docs, F.lit(True))
    for out in (language_id.accepted(docs, model, 0.0), decontaminate.clean(docs, items), decontaminate.clean(docs, items, remove_spans=True), quality_rules.kept(docs, labels), near_dedup.deduplicated(docs)):
        assert out.columns == docs.columns
        assert all(r[c] == f"clash {c}" for r in out.collect() for c in CLASH)
    coded, name = byte_bpe.encode(docs, RANKS)
    back, text = byte_bpe.decode(coded, RANKS, ids=name)
    assert name != "ids" and back.columns == [*docs.columns, name, text]
    assert all(bytes(r[text]) == (r["text"] or "").encode() for r in back.collect())
    assert [r["text"] for r in near_dedup.deduplicated(docs).collect()].count(LONG) + [r["text"] for r in near_dedup.deduplicated(docs).collect()].count(LONG + " tail") == 1


def test_divergence_with_clashing_columns(docs):
    d = docs.withColumn("source", F.when(F.col("doc_id") > 6, F.lit("a"))).withColumns({c: F.lit(1) for c in ("terms", "total", "item", "value", "rank", "counts")})
    got = source_divergence.report(d).collect()
    assert {(r["lang"], r["source"], r["item"]) for r in got if r["part"] == "pair"} == {(g, a, b) for g in ("", "de", "en") for a, b in (("", "a"), ("a", ""))}


def test_language_ties_and_no_letters(spark):
    """Languages with equal texts tie: the first by name; equal rows get equal scores."""
    d = spark.createDataFrame([(n, "alpha beta", g) for n, g in enumerate(["zz", "aa"] * 20)] + [(99, "12 34", "aa")], "doc_id long, text string, lang string")
    rows = language_id.predict(d, language_id.fit(d, F.lit(True)), ["doc_id"]).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] != 99} == {"aa"} and len({r["score"] for r in rows if r["doc_id"] != 99}) == 1
    assert [r["lang_pred"] for r in rows if r["doc_id"] == 99] == ["und"]


def test_urls(spark, labels):
    """Null ids and urls, repeated rows, clashing columns, a url of a thousand keys."""
    many = "http://h.com/p?" + "&".join(f"k{n}=1" for n in range(1000))
    rows = [(None, None), (3, many), (3, many), (7, "http://a.com/x"), (10, "http://a.com/x"), (None, "http://a.com/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "token", "doc_id")})
    got = url_rules.report(pages, labels).collect()
    assert len(got) == len(rows) and all(r["verdict"] == "allow" for r in got)


def test_urls_of_many_unequal_keys(spark):
    """400 URLs that each have most of 30 keys: 2^30 frequent sets, of which those of up to three tokens are found, with exact counts."""
    import itertools
    import time

    rnd = random.Random(4)
    rows, counts, bad_counts = [], {}, {}
    for n in range(400):
        keys = [f"k{k}" for k in range(30) if rnd.random() < 0.9]
        bad = "k3" in keys and "k7" not in keys
        rows.append((f"host{n % 3}.com", "/", f"http://host{n % 3}.com/?" + "&".join(f"{k}=1" for k in keys), bad))
        for size in (1, 2, 3):
            for c in itertools.combinations(sorted("query=" + k for k in keys), size):
                counts[c] = counts.get(c, 0) + 1
                bad_counts[c] = bad_counts.get(c, 0) + bad
    began = time.time()
    urls = spark.createDataFrame(rows, "host string, path string, url string, bad boolean")
    items = urls.select(F.monotonically_increasing_id().alias("row"), "bad", url_rules.tokens().alias("items"))
    items = common.stored(items.select("row", "bad", F.filter("items", lambda t: t.startswith("query=")).alias("items")), "items")
    singles = items.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = {tuple(sorted(r["items"])): r["freq"] for r in url_rules.frequent_sets(items, singles, 40, 3).collect()}
    want = {c: n for c, n in counts.items() if n >= 40} | {tuple(sorted((*c, url_rules.BAD))): n for c, n in bad_counts.items() if n >= 40}
    assert found == {c: n for c, n in want.items()}
    assert isinstance(url_rules.mine(urls).collect(), list)
    assert time.time() - began < 180  # both, on a busy machine


def test_scratch_needs_a_shared_folder():
    """Off local masters an unset spark.checkpoint.dir is an error, not a folder of one machine."""

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: default)
            set = staticmethod(lambda *_: pytest.fail("set"))

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        common.scratch(Session, "x")
