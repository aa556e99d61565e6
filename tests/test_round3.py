"""What the third round's findings were about: work that grew faster than the input."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.functions import text, vec
from mnemograph.llm import near_dedup, source_divergence
from mnemograph.operators import enrich, evaluate, graph, knn, ranking, retrieve, texts
from mnemograph.plans import vectors


def brute_fuzzy(left, right):
    squeeze = lambda t: " ".join(t.split())
    out = {}
    for i, a in ((i, squeeze(a)) for i, a in left):
        same = [j for j, b in right if squeeze(b) == a]
        near = [j for j, b in ((j, squeeze(b)) for j, b in right) if abs(len(a) - len(b)) < 0.1 * max(len(a), len(b)) and (a in b or b in a)]
        if same or near:
            out[i] = min(same or near)
    return out


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_found_once(spark):
    """A row's text is searched and a response parsed once, not once a category, label or letter."""
    d = spark.createDataFrame([(1, "Joy and sad joy, x"), (2, "none"), (3, " "), (4, None)], "id long, text string")
    shares = d.select("id", text.emotion_shares(F.col("text")).alias("s"), text.intensity(text.emotion_shares(F.col("text"))).alias("i"))
    assert plan(shares).count("regexp_extract_all") == 2
    got = {r["id"]: (r["s"], r["i"]) for r in shares.collect()}
    assert got[1][0]["joy"] == pytest.approx(2 / 3) and got[1][0]["sadness"] == pytest.approx(1 / 3) and got[1][1] == pytest.approx(2 / 3)
    assert got[2][0]["neutral"] == 1 and got[2][1] == 0 and set(got[3][0].values()) == set(got[4][0].values()) == {0.0}
    v = d.select(text.emotion_vector(F.col("text")).alias("v"))
    assert plan(v).count("from_json") == 1 and plan(enrich.emotions(d)).count("regexp_extract_all") == 1


def test_encoder_lowers_a_text_once(spark):
    from pyspark.ml.feature import HashingTF

    long = "Größe 𝒳 und Straße. " * 400
    d = spark.createDataFrame([(1, long), (2, "ab"), (3, None)], "id long, text string")
    coded = enrich.encoded(d, normalise=False)
    assert plan(coded).count("lower(") == 1
    got = {r["id"]: np.array(r["vector"]) for r in coded.collect()}
    tf, want = HashingTF(numFeatures=enrich.DIMS), np.zeros(enrich.DIMS)
    low = long.lower()
    for i in range(len(low) - 2):
        want[tf.indexOf(low[i : i + 3])] += 1
    assert (got[1] == want).all() and got[2].sum() == got[3].sum() == 1


def test_sums_of_all_positive_cosines(spark):
    """Every positive pair counts, beyond any number of nearest ones; the query itself doesn't."""
    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 4))
    m[7] = 0
    u = m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]
    keys = spark.createDataFrame([(i, v.tolist(), i % 3 if i % 10 else None) for i, v in enumerate(m)] + [(99, None, 1)], "id long, vec array<double>, node int").repartition(3)
    q = keys.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    got = {(r["qid"], r["node"]): r["sim"] for r in knn.sums(q, keys, block=2, slab=16).collect()}
    want = {}
    for a in range(5):
        for b in range(90):
            if a != b and u[a] @ u[b] > 0:
                k = (a, b % 3 if b % 10 else None)
                want[k] = want.get(k, 0) + u[a] @ u[b]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_synonyms_of_equal_vectors(spark):
    """Many names on few vectors: as brute force, from a search of the distinct vectors alone."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(6, 3))
    own = [int(x) for x in rng.integers(0, 6, 80)]
    names = [f"entity {i:02d}" if i % 7 else "" if i % 2 else "x" for i in range(80)]
    d = spark.createDataFrame([(i, names[i], m[own[i]].tolist()) for i in range(80)], "id long, name string, vec array<double>").repartition(3)
    u = m / np.linalg.norm(m, axis=1)[:, None]
    w = np.round(u @ u.T, 12)
    for most in (2, 101):
        want = set()
        for a in range(80):
            if len(names[a].replace(" ", "")) > 2:
                others = [b for b in range(80) if b != a and names[b] and w[own[a], own[b]] >= 0.3]
                want |= {(a, b) for b in sorted(others, key=lambda b: (-w[own[a], own[b]], b))[:most]}
        assert {(r["src"], r["dst"]) for r in graph.synonym_edges(d, 0.3, most).collect()} == want
    assert graph.vector_classes(d, "classes")[1].count() == 6


def test_mentions_are_made_once(spark):
    """A deletion goes through the mentions once; a passage's edges follow its chunk and only the entities' are joined."""
    t = spark.createDataFrame([("c1", "a", "p", "b"), ("c1", "a", "q", "a"), ("c2", "a", "p", "b"), ("c2", "b", "q", "d"), ("c3", "d", "q", "e"), ("c4", "a", "r", "e")], "chunk_id string, s string, p string, o string")
    deleted = spark.createDataFrame([("c2",), ("c2",), ("c3",)], "chunk_id string")
    left = graph.survivors(graph.mentions(t), deleted)
    assert plan(left).count("explode(") == 1
    assert {tuple(r) for r in left.collect()} == {("a", 2), ("b", 1), ("d", 0), ("e", 1)}
    edges = graph.delete(t, graph.build(t)[1], deleted)["edges"]
    assert {tuple(r) for r in edges.collect()} == {("a", "b", 2.0), ("b", "a", 2.0), ("a", "e", 1.0), ("e", "a", 1.0), ("c1", "a", 1.0), ("c1", "b", 1.0), ("c4", "a", 1.0), ("c4", "e", 1.0)}


def test_gold_by_class_equals_pairs(spark):
    """Judging, counting, ranks and least gold from classes are those of the pairs, which aren't formed."""
    rng = np.random.default_rng(4)
    label = [int(x) if x < 3 else None for x in rng.integers(0, 4, 30)]
    members = spark.createDataFrame([(i, label[i]) for i in range(30)] + [(30, 9)], "id long, label int")
    asked = [(q, 9 if q == 30 else label[q]) for q in (0, 5, 10, 15, 20, 30)] + [(99, 1)]
    queries = spark.createDataFrame(asked, "qid long, label int")
    pairs = spark.createDataFrame([(q, i) for q, own in asked for i in range(30) if i != q and own is not None and label[i] == own], "qid long, id long")
    rankings = spark.createDataFrame([(q, int(i), n) for q, _ in asked for n, i in enumerate(rng.permutation(30)[:8], 1)], "qid long, id long, rank long")
    gold = evaluate.Classes(queries, members)
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    for use in (lambda g: evaluate.judged(rankings, g).select("qid", "id", "rank", "hit"), evaluate.gold_counts, evaluate.first_gold, lambda g: evaluate.gold_ranks(rankings, g), lambda g: evaluate.recall_at(rankings, g, [1, 5])):
        assert rows(use(gold)) == rows(use(pairs))
    assert rows(evaluate.rank_metrics(rankings, gold, 5).select("qid", F.round("map", 9), F.round("ndcg", 9))) == rows(evaluate.rank_metrics(rankings, pairs, 5).select("qid", F.round("map", 9), F.round("ndcg", 9)))


def test_best_in_tasks(spark):
    """As top_k with ties, whatever the parts; a task hands on k rows a query."""
    rng = np.random.default_rng(6)
    d = spark.createDataFrame([(int(q), f"p-{i}", float(s)) for i, (q, s) in enumerate(zip(rng.integers(0, 7, 3000), rng.integers(0, 40, 3000)))], "qid long, id string, score double").repartition(3)
    rows = lambda x: sorted(map(tuple, x.collect()))
    got = ranking.best_in_tasks(d, 5, size=100)
    assert rows(got) == rows(ranking.top_k(d, 5)) and got.count() == 35 and "MapInArrow" in plan(got)
    assert ranking.best_in_tasks(d.limit(0), 5).count() == 0


def test_lists_of_links(spark):
    """One row a point, as from the pairs; the lists come from the tasks, unshuffled."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(70, 3))
    d = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist(), float(r)) for i, (v, r) in enumerate(zip(m, rng.uniform(0, 3, 70)))], "id long, unit array<double>, radius double")
    want = {}
    for r in sorted(retrieve.hyperbolic_links(d, block=16).collect(), key=lambda r: (round(r["distance"], 6), r["dst"])):
        want.setdefault(r["src"], []).append(r["dst"])
    lists = retrieve.hyperbolic_links(d, block=16, lists=True)
    assert {r["src"]: r["dsts"] for r in lists.collect()} == want and want
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()


def test_texts_with_common_fingerprints_alone(spark):
    """Texts that share all their fingerprints with more than HOT others, of many lengths, contained or not."""
    r = random.Random(4)
    body = "".join(r.choice("abcdefgh ij") for _ in range(900)).strip()
    right = [(n, body[: 800 + n] if n % 3 else body[n:] + "tail" * (n % 5)) for n in range(100)] + [(200, "ab" * 300), (201, "ab" * 310 + "a")]
    left = [(n, t[5 + n % 9 : len(t) - 7]) for n, t in right] + [(500, body[:400] + "#" + body[401:850])]
    frames = spark.createDataFrame(left, "lid long, text string"), spark.createDataFrame(right, "rid long, text string")
    want = brute_fuzzy(left, right)
    assert len(want) > 90 and 500 not in want
    for hot in (0, 3, texts.HOT):
        assert {x["lid"]: x["rid"] for x in texts.fuzzy_match(*frames, hot=hot).collect()} == want


def test_hot_texts_are_hashed_at_their_fingerprint_alone(spark):
    """A task hashes a part for each place of the fingerprint, not all parts of each length that is asked for."""
    r = random.Random(5)
    body = "".join(r.choice("abcdefgh ij") for _ in range(2000))
    large = spark.createDataFrame([(n, body[: 1900 + n]) for n in range(60)], "n long, t string")
    small = spark.createDataFrame([(n, body[3 : 1790 + n]) for n in range(60)], "n long, t string")
    marks = texts.fingerprints(small, every=False).groupBy("n").agg(F.min(F.struct("level", "mark")).alias("r")).select("n", "r.level", "r.mark")
    path = texts.asking(small.join(marks, "n"))
    made = spark.sparkContext.accumulator(0)
    got = {tuple(x) for x in texts.anchored(large, path, compared=made).collect()}
    assert got >= {(i, j) for i in range(60) for j in range(60) if 1790 + i <= 1900 + j and 1787 + i > 0.9 * (1900 + j)}
    assert made.value <= 60 * 60 * 2


def test_runs_of_postings(spark):
    """Blocks of a run hold every posting once, in order; what tasks read back has one string for each source."""
    held = source_divergence.Postings(10**6)
    texts = [("en", "b", b"Two two one"), ("en", "a", b"one \xc3\xa9"), ("de", "a", b"one"), ("fr", "a", None), ("en", "c", b"...")] + [("en", f"s{n % 7}", b"w%d x%d one" % (n, n % 3)) for n in range(200)]
    want, docs = Counter(), Counter()
    for g, s, t in texts:
        held.add(g, s, t)
        words = (t or b"").lower().translate(source_divergence.TERMS).split()
        want.update((g, w, s) for w in words)
        docs.update((g, w) for w in set(words))
    rows = list(held.spilled(3, 5))
    assert not held.held and list(held.spilled(3, 5)) == []
    got = {}
    for shard, lang, head, terms, found, sizes, sources, counts in rows:
        assert head == terms[0] and list(terms) == sorted(terms) and len(sources) == len(counts) == sum(sizes)
        assert {zlib.crc32(t) % 3 for t in terms} == {shard} and sum(sizes[:-1]) < 5
        entries = iter(zip(sources, counts))
        for term, n, size in zip(terms, found, sizes):
            assert n == docs[lang, term]
            got |= {(lang, term, s): c for s, c in (next(entries) for _ in range(size))}
    assert got == want
    where = [(lang, shard, head) for shard, lang, head, *_ in rows]
    assert all(a[2] < b[2] for a, b in zip(where, where[1:]) if a[:2] == b[:2])
    d = spark.createDataFrame([(g, s, t.decode() if t else None) for g, s, t in texts], "lang string, source string, text string").coalesce(1)
    batches = source_divergence.runs(d, 1, "text", "lang", "source", 10**6, 10**6).toArrow().to_batches()
    back = [s for row in source_divergence.opened(batches) for s in row[6] if row[1] == "en"]
    assert len({id(s) for s in back}) == len(set(back)) < len(back)


def test_near_pairs_leave_their_first_bucket_alone(spark):
    """Nodes of different components that share buckets are compared in the first alone, with strays on one or both sides."""
    r = random.Random(2)
    nodes = {n: (n // 4 if n < 20 else n, r.sample(range(-9, 9), r.randrange(1, 12))) for n in range(60)}
    shape = ("n", "total", *(f"p{k}" for k in range(near_dedup.PARITY)))
    d = spark.createDataFrame([(b, bytes([n]), bytes([c]), *[10] * 2, *[0] * near_dedup.PARITY) for n, (c, bands) in nodes.items() for b in bands], ", ".join(["band long", "key binary", "comp binary", *(f"{c} long" for c in shape)]))
    got = [tuple(x[c][0] for c in "ab") for x in near_dedup.stray_pairs(near_dedup.mixed_only(d), 0.8).collect()]
    want = {(i, j) for i in nodes for j in nodes if i < j and nodes[i][0] != nodes[j][0] and set(nodes[i][1]) & set(nodes[j][1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_gold_by_title_opens_a_row_once(spark):
    rows = [(1, [("a", 0), ("b", 0), ("a", 1)], [("a", ["x"]), ("c", ["y"])]), (1, [("c", 0)], None), (2, None, [("a", ["z"])]), (None, [("a", 0)], [("a", ["z"])]), (3, [(None, 0)], [(None, ["z"])])]
    d = spark.createDataFrame(rows, "question long, facts array<struct<title: string, i: int>>, context array<struct<title: string, sentences: array<string>>>")
    _, gold = texts.gold_by_title(d)
    assert sorted(map(tuple, gold.collect())) == [(1, "a"), (1, "c")]
    assert "Join" not in plan(gold) and plan(gold).count("Generate") == 1


def test_links_by_pairs_of_pieces(spark):
    """Tasks are as many as the pairs need, a pair is computed once for both directions, and the links are all of them."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(300, 5))
    m[1], m[7] = m[0], 0
    r = rng.uniform(0, 3, 300)
    r[[20, 21, 22]] = 14, 14, np.inf
    u = m / np.maximum(np.linalg.norm(m, axis=1)[:, None], 1e-300)
    rows = [(i, v.tolist(), float(x)) for i, (v, x) in enumerate(zip(u, r))] + [(900, None, 1.0), (901, [1.0] * 5, None), (902, u[0].tolist(), float("nan"))]
    d = spark.createDataFrame(rows, "id long, unit array<double>, radius double").repartition(2)
    compared = spark.sparkContext.accumulator(0)
    links = retrieve.hyperbolic_links(d, block=50, compared=compared, size=3000)
    assert 10 <= links.rdd.getNumPartitions() <= 20
    got = [(x["src"], x["dst"], x["distance"]) for x in links.collect()]
    assert compared.value < 0.65 * 300**2
    z = u * np.tanh(r / 2)[:, None]
    s = (z * z).sum(1)
    want = {(i, j): np.arccosh(1 + 2 * ((z[i] - z[j]) ** 2).sum() / ((1 - s[i]) * (1 - s[j]) + 1e-7)) for i in range(300) for j in range(300) if i != j}
    want = {p: x for p, x in want.items() if x < 1.5}
    assert len(got) == len(want) and {(i, j) for i, j, _ in got} == set(want)
    assert all(abs(want[i, j] - x) < 1e-5 for i, j, x in got)


@pytest.mark.parametrize("theta", [0.0, 0.3, 1.5, 6.0, 900.0])
def test_near_pairs_by_tiles(theta, monkeypatch):
    """A product decides as the distance does, at any threshold, near the boundary and beside a NaN."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(90, 3))
    z = m / np.linalg.norm(m, axis=1)[:, None] * np.tanh(rng.choice([0.2, 1, 3, 9, 30], 90) / 2)[:, None]
    z[5], z[6] = z[4], np.nan
    u, v, uu = z[:50], z[20:], (z * z).sum(1)
    monkeypatch.setattr(retrieve, "TILE", (16, 32))
    got = {(int(i), int(j)): x for a, b, d, _ in retrieve.near_pairs(u, v, theta) for i, j, x in zip(a, b, d)}
    d = np.arccosh(1 + 2 * np.maximum(uu[:50, None] + uu[None, 20:] - 2 * u @ v.T, 0) / ((1 - uu[:50])[:, None] * (1 - uu[20:])[None, :] + 1e-7))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(d < theta))}
    assert set(got) == want and all(abs(d[p] - x) < 1e-6 for p, x in got.items())


def test_norm_is_summed_once(spark):
    """unit() sums a vector's squares once, not once for each of its numbers."""
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [])], "id long, v array<float>")
    u = d.select("id", vec.unit(F.col("v")).alias("u"))
    assert {r["id"]: r["u"] for r in u.collect()} == {1: [pytest.approx(0.6), pytest.approx(0.8)], 2: [0.0, 0.0], 3: None, 4: []}
    assert plan(u).count("aggregate(") == 1


def test_links_round_without_decimals(spark):
    """jn7's distances are rounded as doubles: a decimal a row took most of a task."""
    links = vectors.jn7_hyperbolic_links(spark, "/root/testdata/sf0.001")
    assert "round(" not in plan(links) and all(abs(r["distance"] * 1e5 - round(r["distance"] * 1e5)) < 1e-9 * 1e5 for r in links.limit(200).collect())


def test_lists_by_tasks_of_bounded_size(spark):
    """As many tasks as the pairs need; lists that are too many to be held are made by halves, in the same order."""
    rng = np.random.default_rng(10)
    m = rng.normal(size=(130, 3))
    r = rng.choice([0.5, 1.0, 2.0, 13.0], 130)
    r[3] = np.nan
    d = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist(), float(x)) for i, (v, x) in enumerate(zip(m, r))], "id long, unit array<double>, radius double")
    want = {}
    for x in sorted(retrieve.hyperbolic_links(d, block=32).collect(), key=lambda x: (np.floor(x["distance"] * 1e6 + 0.5), x["dst"])):
        want.setdefault(x["src"], []).append(x["dst"])
    lists = retrieve.hyperbolic_links(d, block=32, lists=True, size=1000, most=150)
    got = [tuple(x) for x in lists.collect()]
    assert lists.rdd.getNumPartitions() == -(-130 // 7) and len(got) == len(want) and dict(got) == want
    assert max(map(len, want.values())) * 7 > 150
    assert retrieve.hyperbolic_links(d.limit(0), lists=True).count() == 0
