"""Library operators on small frames, against brute force or rows written by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.functions import text
from mnemograph.operators import enrich, evaluate, fusion, graph, knn, ranking, texts
from mnemograph.sources import stores
from mnemograph.streaming import streams


def brute_fuzzy(left, right):
    squeeze = lambda t: " ".join(t.split())
    out = {}
    for i, a in left:
        a = squeeze(a)
        same = [j for j, b in right if squeeze(b) == a]
        near = [j for j, b in right if abs(len(a) - len(squeeze(b))) < 0.1 * max(len(a), len(squeeze(b))) and (a in squeeze(b) or squeeze(b) in a)]
        if same or near:
            out[i] = min(same or near)
    return out


def test_fuzzy_match(spark):
    """Contained texts of all lengths, around powers of two too, and texts that share much but aren't contained."""
    r = random.Random(9)
    made = lambda n: "".join(r.choice("abc d") for _ in range(n)).strip() or "x"
    right = [(n, made(r.choice([1, 2, 5, 15, 16, 17, 31, 33, 64, 130, 140, 260, 1030]))) for n in range(120)]
    right += [(200 + n, t + "  " + t) for n, t in right[:5]] + [(300, right[0][1])]
    left = []
    for n, t in right:
        cut = r.randrange(0, max(1, len(t) // 9))
        head = r.randrange(cut + 1)
        left += [(n, t[head : len(t) - (cut - head)] or "y"), (1000 + n, t + "q" * (len(t) // 11)), (2000 + n, "zz" + t[: len(t) // 2])]
    left.append((5000, "a  \n b"))
    d = texts.fuzzy_match(spark.createDataFrame(left, "lid long, text string"), spark.createDataFrame(right, "rid long, text string"))
    got = {x["lid"]: x["rid"] for x in d.collect()}
    assert got == brute_fuzzy(left, right) and d.count() == len(got)
    none = spark.createDataFrame([(1, None)], "rid long, text string")
    assert texts.fuzzy_match(spark.createDataFrame([(1, "a"), (2, None)], "lid long, text string"), none).count() == 0


def test_negatives_are_enough(spark):
    """n others whenever there are as many, however sparse the ids are and whatever their number."""
    for total in (1, 2, 3, 6, 7, 30):
        ids = [1000 * n + n % 7 for n in range(total)]
        d = spark.createDataFrame([(i,) for i in ids], "id long")
        q = spark.createDataFrame([(n, ids[n % total]) for n in range(20)] + [(99, None)], "qid long, gold long")
        by = {}
        for r in texts.seeded_others(q, d.union(d), 5).collect():
            by.setdefault(r["qid"], []).append(r["id"])
        for n in range(20):
            got = by.get(n, [])
            assert len(got) == len(set(got)) == min(5, total - 1) and ids[n % total] not in got and set(got) <= set(ids)
        assert len(by[99]) == min(5, total)


def test_numbering(spark):
    rows = [(n * 7 % 50, None if n % 9 == 0 else n % 4) for n in range(50)]
    d = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = sorted((r["place"], r["b"] is not None, r["b"] or 0, r["a"]) for r in ranking.numbered(d, "b", "a").collect())
    assert [g[0] for g in got] == list(range(50)) and got == sorted(got, key=lambda g: g[1:])
    assert sorted(r["a"] for r in ranking.first_rows(d, 13, "a").collect()) == list(range(13))
    assert ranking.first_rows(d.limit(0), 3, "a").count() == 0


def test_descriptions(spark):
    answer = "Intro\n- Paris: 1. joy, hope;\nParis: later\nRome - 2) calm.\nlondon and the fog, grey cold: dull; wet old sad dim low far\nOslo:"
    names = ["Paris", "Rome", "London", "Oslo", "Nowhere"]
    r = spark.createDataFrame([(1, answer), (2, None)], "id long, response string")
    e = spark.createDataFrame([(1, n) for n in names] + [(2, "Paris")], "id long, entity string")
    got = {(x["id"], x["entity"]): x["description"] for x in texts.described(r, e).collect()}
    assert got == {(1, "Paris"): "joy, hope", (1, "Rome"): "calm", (1, "London"): "london, fog, grey, cold, dull, wet, old, sad", (1, "Oslo"): "Oslo", (1, "Nowhere"): "", (2, "Paris"): ""}


def test_plug_points(spark):
    d = spark.createDataFrame([(1, "joy joy anger"), (2, None), (3, "")], "i long, text string")
    seen = []

    def model(batch):
        return [[float(len(t)), 3.0] for t in batch]

    got = {r["i"]: r["v"] for r in enrich.encoded(d, out="v", model=model, instruction="q:", batch=2).collect()}
    assert got[1] == pytest.approx([15 / np.hypot(15, 3), 3 / np.hypot(15, 3)]) and got[2] == got[3] == pytest.approx([2 / np.hypot(2, 3), 3 / np.hypot(2, 3)])
    assert {r["i"]: r["e"] for r in enrich.emotions(d, out="e", model=model).collect()}[3] == [0.0, 3.0] and not seen
    default = {r["i"]: r["v"] for r in enrich.encoded(d, out="v").collect()}
    assert len(default[1]) == enrich.DIMS and np.linalg.norm(default[1]) == pytest.approx(1)
    e = {r["i"]: r["e"] for r in enrich.emotions(d, out="e").collect()}
    at = text.CATEGORIES.index
    assert e[1][at("joy")] == pytest.approx(2 / 3) and e[1][at("anger")] == pytest.approx(1 / 3) and e[3] == [0.0] * 10


def test_particles_of_texts(spark):
    d = spark.createDataFrame([(1, "Anna felt joy. Berta felt rage! Nobody else"), (2, None), (3, "no names")], "text_id long, text string")
    said = spark.createDataFrame([(1, "Berta", "calm")], "text_id long, entity string, description string")
    rows = {(r["text_id"], r["entity"]): r for r in enrich.particles(d, said).collect()}
    at = text.CATEGORIES.index
    assert set(rows) == {(1, "Anna"), (1, "Berta"), (1, "Nobody")}
    assert rows[1, "Anna"]["emotions"][at("joy")] == 1 and rows[1, "Berta"]["emotions"][at("neutral")] == 1
    assert rows[1, "Anna"]["intensity"] == pytest.approx(1) and rows[1, "Anna"]["weight"] == pytest.approx(51)
    assert {r["entity"]: r["emotions"][at("anger")] for r in enrich.particles(d).collect()}["Berta"] == 1


def test_json_arrays_and_ingest(spark, tmp_path):
    d = spark.createDataFrame([(1, "a\nb"), (2, None), (3, '"q"')], "i long, t string")
    stores.write_json_arrays(d.repartition(2), str(tmp_path / "arrays"))
    assert sorted(tuple(r) for r in stores.read_json_array(spark, str(tmp_path / "arrays"), d.schema).collect()) == [(1, "a\nb"), (2, None), (3, '"q"')]
    chunks = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "text string")
    old = stores.hashed(chunks.where("text = 'x'"), "text", "chunk-")
    after, counts = stores.ingest(chunks, {"a": old, "b": old.limit(0)})
    assert {r["store"]: (r["stored"], r["added"]) for r in counts.collect()} == {"a": (2, 1), "b": (2, 2)}
    assert stores.get(after["a"], old).count() == 1 and stores.get(after["a"], where=F.col("content") == "y").count() == 1


def test_upserted_buckets(spark, tmp_path):
    """Batches rewrite the buckets they touch alone; the newest version of each key is left."""
    schema = "k long, v long, t string"
    for n, rows in enumerate([[(i, 1, "a") for i in range(40)], [(3, 2, "b"), (50, 1, "b")], [(3, 1, "old"), (4, 1, "same")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path = str(tmp_path / "out")
    q = streams.upserted(s, "k", "v", path, buckets=8).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"]
    got = {r["k"]: r["t"] for r in streams.snapshot(spark, path, last, spark.createDataFrame([], schema)).collect()}
    assert len(got) == 41 and got[3] in ("b",) and got[4] == "same" and got[50] == "b" and got[7] == "a"
    held = streams.manifest(spark, path, last)
    assert min(held.values()) == 0 and max(held.values()) == last  # buckets that no later batch touched lie where they were


def test_miss_sets_and_profiles(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "qid long, id long")
    hit = lambda *qs: spark.createDataFrame([(n, n * 10, 1) for n in qs] + [(9, 9, 1)], "qid long, id long, rank int")
    sets = evaluate.miss_sets(q, {"a": hit(1, 2), "b": hit(1)}, gold, 3)
    assert sorted((r["qid"], r["bucket"]) for r in sets.collect()) == [(1, "a hit"), (1, "b hit"), (2, "a hit"), (2, "b missed"), (3, "all missed")]
    rows = sets.withColumns({"question": F.when(F.col("qid") == 2, "Fear and hope").otherwise("hope"), "answer": F.lit("x"), "chunk": F.lit("yy"), "mass": F.col("qid").cast("double")})
    got = {r["bucket"]: r for r in evaluate.set_profiles(rows, ["hope", "fear"]).collect()}
    assert got["a hit"]["n"] == 2 and got["a hit"]["keywords"] == "hope:2,fear:1" and got["a hit"]["mean_mass"] == 1.5 and got["all missed"]["keywords"] == "hope:1"


def test_best_settings(spark):
    """The grid's best setting by a plain evaluation of each."""
    r = random.Random(3)
    pairs = [(q, i, r.random(), r.random()) for q in range(4) for i in range(8)]
    gold = {(q, i) for q in range(4) for i in range(8) if r.random() < 0.3} | {(q, 0) for q in range(4)}
    d = spark.createDataFrame(pairs, "qid long, id long, s double, e double")
    runs = fusion.grid(d, [0.2, 0.5])
    score = {}
    for x in runs.collect():
        score.setdefault(x["setting"], {}).setdefault(x["qid"], []).append((-round(x["score"], 9), x["id"]))
    mean = {}
    for setting, by in score.items():
        values = []
        for q, rows in by.items():
            first = next((n for n, (_, i) in enumerate(sorted(rows)[:10], 1) if (q, i) in gold), None)
            values.append(1 / first if first else 0)
        mean[setting] = round(sum(values) / 4, 6)
    best = max((v, s) for s, v in mean.items())
    got = {x["metric"]: (x["value"], x["setting"]) for x in evaluate.best_settings(runs, spark.createDataFrame(sorted(gold), "qid long, id long")).collect()}
    assert got["mrr"] == pytest.approx(best[0]) or got["mrr"][1] == best[1]
    assert got["mrr"][0] == pytest.approx(best[0], abs=1e-6)


def test_gold_and_titles(spark):
    q = spark.createDataFrame([(1, 5), (2, 6)], "qid long, chunk_id long")
    c = spark.createDataFrame([(5, "five"), (7, "x")], "chunk_id long, text string")
    assert {r["qid"]: r["gold"] for r in evaluate.gold_documents(q, c).collect()} == {1: ["five"], 2: []}
    nested = spark.createDataFrame([("q", [("A", 0), ("Z", 1)], [("A", ["a.", "b."]), ("B", ["c."])])], "question string, facts array<struct<title:string,i:int>>, context array<struct<title:string,sentences:array<string>>>")
    corpus, gold = texts.gold_by_title(nested)
    assert {tuple(r) for r in corpus.collect()} == {("A", "a. b."), ("B", "c.")} and [tuple(r) for r in gold.collect()] == [("q", "A")]


def test_synonym_rules(spark):
    """Names of under three characters that count look for nothing, empty ones aren't found, the cut holds."""
    rows = [(1, "abc", [1.0, 0.0]), (2, "a-b", [1.0, 0.1]), (3, "", [1.0, 0.2]), (4, "abcd", [1.0, 0.3]), (5, "xyz", [0.0, 1.0])]
    d = spark.createDataFrame(rows, "id long, name string, vec array<double>")
    assert {(r["src"], r["dst"]) for r in graph.synonym_edges(d, least=0.5).collect()} == {(1, 2), (1, 4), (4, 1), (4, 2)}
    assert {(r["src"], r["dst"]) for r in graph.synonym_edges(d, least=0.5, most=1).collect()} == {(1, 2), (4, 2)}


def test_threshold_search_in_blocks(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(70, 6))
    keys = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(m)], "id long, vec array<double>").repartition(3)
    q = keys.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = {(r["qid"], r["id"]) for r in knn.search(q, keys, least=0.4, block=4, slab=11).collect()}
    u = m / np.linalg.norm(m, axis=1)[:, None]
    assert got == {(i, j) for i in range(0, 70, 3) for j in range(70) if i != j and u[i] @ u[j] >= 0.4}


def test_approximate_search_recall(spark):
    """On the given vectors at least nine tenths of the true neighbours are found, and all with every list probed; on clustered ones with few probes."""
    import os

    from mnemograph.plans import fixtures, vectors

    def recall(q, keys, **settings):
        exact = {(r["qid"], r["id"]) for r in knn.search(q, getattr(keys, "keys", keys), k=10).collect()}
        return len(exact & {(r["qid"], r["id"]) for r in knn.approximate(q, keys, k=10, **settings).collect()}) / len(exact)

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 4
    m = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres])
    keys = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in enumerate(m)], "id long, vec array<double>")
    q = keys.where("id % 9 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    assert recall(q, keys, lists=6, probes=2, parts=4) >= 0.9 and recall(q, keys, lists=6, probes=6, parts=4, refine=400) == 1
    sf = "/root/testdata/sf0.01"
    if os.path.isdir(sf):
        q, keys = fixtures.query_vectors(spark, sf), vectors.keys_of(spark, sf)
        made = knn.index(keys, 32)
        assert recall(q, made, probes=24, refine=4) >= 0.9
        scored = knn.candidates(q, made, 10, 24, 4).groupBy("qid", "scored", F.pmod("id", F.lit(1)).alias("x")).count()
        assert scored.agg(F.max("scored")).first()[0] * 24 < keys.count() / 5
        assert {r["list"] for r in made.keys.select("list").distinct().collect()} <= set(range(32)) and made.keys.count() == keys.count()


def test_search_by_any_ids(spark):
    """Queries and keys with text ids, with pairs, and of two types; a key with the query's id is left out where both are of one type."""
    m = np.random.default_rng(4).normal(size=(20, 3))
    rows = [(f"entity-{i}", i, [float(x) for x in v]) for i, v in enumerate(m)]
    d = spark.createDataFrame(rows, "name string, n long, vec array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    near = lambda i, own: [j for j in sorted(range(20), key=lambda j: -u[i] @ u[j]) if own or j != i][:3]
    by_name = knn.search(d.select(F.col("name").alias("qid"), F.col("vec").alias("qvec")), d.select(F.col("name").alias("id"), "vec"), k=3).collect()
    assert {(r["qid"], r["id"]) for r in by_name} == {(f"entity-{i}", f"entity-{j}") for i in range(20) for j in near(i, False)}
    mixed = knn.search(d.select(F.col("n").alias("qid"), F.col("vec").alias("qvec")), d.select(F.col("name").alias("id"), "vec"), k=3).collect()
    assert {(r["qid"], r["id"]) for r in mixed} == {(i, f"entity-{j}") for i in range(20) for j in near(i, True)}
    itself = knn.search(d.select(F.col("n").alias("qid"), F.col("vec").alias("qvec")), d.select(F.col("n").alias("id"), "vec"), k=3, itself=True).collect()
    assert {(r["qid"], r["id"]) for r in itself} == {(i, j) for i in range(20) for j in near(i, True)}
    listed = knn.approximate(d.select(F.col("name").alias("qid"), F.col("vec").alias("qvec")), d.select(F.col("name").alias("id"), "vec"), 3, lists=4, probes=4, refine=20, parts=3).collect()
    assert {(r["qid"], r["id"]) for r in listed} == {(r["qid"], r["id"]) for r in by_name}


def test_overlaps_of_a_long_text(spark):
    """A text of 100,000 words and one word of 20,000 characters; bins give each overlapping pair once."""
    import re

    words = " ".join(("Xy" if n % 7 else "Abc Def") + str(n % 3) * (n % 5) for n in range(100_000)) + " " + "Z" * 20_000
    rnd = np.random.default_rng(9)
    cuts = sorted({int(a) for a in rnd.integers(0, len(words), 4000)})
    spans = [(1, a, min(a + int(n), len(words))) for a, n in zip(cuts, rnd.integers(1, 300, len(cuts)))] + [(1, 5, 5), (2, 0, 9)]
    d = spark.createDataFrame([(1, words), (2, "one two"), (3, None)], "doc_id long, text string")
    s = spark.createDataFrame(spans, "doc_id long, char_start int, char_end int")
    got = [(r["doc_id"], r["token_no"], r["char_start"], r["char_end"]) for r in texts.overlaps(texts.tokens(d), s).collect()]
    places = [m.span() for m in re.finditer(r"\S+", words)]
    starts, ends = np.array([a for a, _ in places]), np.array([b for _, b in places])
    want = [(1, int(n), a, b) for _, a, b in spans[:-2] for n in range(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left"))]
    assert sorted(got) == sorted(want + [(2, 0, 0, 9), (2, 1, 0, 9)])


def test_fuzzy_match_of_boilerplate(spark):
    """Thousands of texts of one long line with a short ending of their own: candidates stay few for each; a text that all contain is found by its hash."""
    line = "this notice is part of every page and says the same thing on each of them in the same words always "
    left = [(n, line + f"no {n}") for n in range(3000)] + [(9000, line.strip()), (9001, line.strip()[1:]), (9002, line.strip()[12:])]
    right = [(n, line + f"no {n} x") for n in range(3000)]
    a, b = spark.createDataFrame(left, "lid long, text string"), spark.createDataFrame(right, "rid long, text string")
    got = {r["lid"]: r["rid"] for r in texts.fuzzy_match(a, b).collect()}
    want = {n: n for n in range(3000)} | {9000: 0, 9001: 0}
    near = {n: min((m for m in range(3000) if f"no {n}" in f"no {m} x" and (f"no {m} x").startswith(f"no {n}")), default=None) for n in range(0, 3000, 97)}
    assert all(got[n] == near[n] for n in near) and got[9000] == want[9000] and got[9001] == want[9001] and len(got) == 3002


def test_run_log_over_ranges(spark):
    """One file over many ranges, metric lines before the first epoch line, files that end within a range."""
    rows, want, epoch = [], [], None
    for n in range(400):
        if n % 37 == 9:
            epoch = n
            rows.append(("long", n, f"Epoch {n}/999"))
        else:
            rows.append(("long", n, f"x Train Loss: {n}.5"))
            want.append(("long", epoch, "Train Loss", n + 0.5))
    for f in range(30):
        rows += [(f"short {f}", 0, f"Epoch {f}/9"), (f"short {f}", 1, "Val Loss: 1.25"), (f"short {f}", 2, None)]
        want.append((f"short {f}", f, "Val Loss", 1.25))
    got = stores.run_log(spark.createDataFrame(rows, "file string, n long, value string").repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert stores.run_log(spark.createDataFrame([], "file string, n long, value string")).count() == 0


def test_enrichment_asks_once_a_key(spark, tmp_path):
    """The model is called once for each missing key, however often a key is asked for and however often the result is used."""

    def model(d):
        def run(batches):
            import uuid

            import pyarrow as pa

            for batch in batches:
                keys = batch.column("key").to_pylist()
                for k in keys:
                    (tmp_path / f"{k}-{uuid.uuid4().hex}").write_text("")
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([f"r {k}" for k in keys], pa.string())], ["key", "result"])

        return d.select("key").mapInArrow(run, "key string, result string")

    asked = spark.createDataFrame([(n, f"k{n % 5}") for n in range(40)], "id long, key string").repartition(4)
    cache = spark.createDataFrame([("k0", "old"), ("k9", "other")], "key string, result string")
    rows, new = enrich.completed(asked, cache, model)
    assert {(r["id"], r["result"]) for r in rows.collect()} == {(n, "old" if n % 5 == 0 else f"r k{n % 5}") for n in range(40)}
    rows.count(), new.count()
    again, none = enrich.completed(asked, cache.union(new), model)
    assert again.count() == 40 and none.count() == 0
    assert sorted(f.name[:2] for f in tmp_path.iterdir()) == ["k1", "k2", "k3", "k4"]


def test_labelled_samples_brute_force(spark):
    import hashlib
    import re

    docs = [(1, "Chapter 1\nNew York and San Marco met Old Tom Joad there.\nmore of it"), (2, "no names in this text at all"), (3, None), (4, "Big Ben Ben " + " ".join(f"Aa Bb{n}," for n in range(20))), (5, "  New York and San Marco met Old Tom Joad there. ")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda span, text: hashlib.md5((span + "|" + text[:100]).encode()).hexdigest()
    want, labels = {}, {}
    for i, t in docs:
        body = (t or "").strip().removeprefix("Chapter 1\n").strip()
        found = [(m.start(), m.end(), m.group()) for m in re.finditer(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", body)][:10]
        for n, (a, b, span) in enumerate(found):
            if n != 1:  # every second span has no label
                labels[key(span, body)] = [float(n), 2.0]
        own = [(a, b, s, labels[key(s, body)]) for a, b, s in found if key(s, body) in labels]
        if own:
            want[i] = (body, own)
    spans = texts.keyed_spans(d)
    got = texts.labelled_samples(spans, spark.createDataFrame([*labels.items(), *labels.items()], "label_key string, soft_label array<double>")).collect()
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        body, own = want[r["doc_id"]]
        assert r["text"] == body and [(t["char_start"], t["char_end"], t["span_text"], t["soft_label"]) for t in r["targets"]] == own
        assert all(abs(t["intensity"] - np.hypot(*t["soft_label"])) < 1e-9 for t in r["targets"])


def test_merged_texts_in_pieces(spark):
    """Parts in order; a text over the bound goes on in further pieces and loses nothing."""
    d = spark.createDataFrame([(n, "Same\n" + chr(97 + n) * 10) for n in range(12)] + [(50, "Other")], "place long, text string")
    whole = {(r["first_line"], r["piece"]): r["merged"] for r in texts.merged_by_first_line(d, "P: ").collect()}
    cut = sorted((r["first_line"], r["piece"], r["merged"]) for r in texts.merged_by_first_line(d, "P: ", most=40).collect())
    assert set(whole) == {("Same", 0), ("Other", 0)} and whole["Other", 0] == "P: Other"
    assert whole["Same", 0] == "P: Same\n" + "\n".join(chr(97 + n) * 10 for n in range(12))
    assert "".join(m for f, _, m in cut if f == "Same") == whole["Same", 0] and len(cut) > 3
