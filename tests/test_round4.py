"""Tests of the fourth round's findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemograph.functions import text
from mnemograph.operators import graph, knn, walk
from mnemograph.plans import graphs


def test_emotion_response_cut_short_keeps_signs(spark):
    """A score under 0 counts the same in a whole answer and in one that was cut short."""
    whole = 'Scores: {"joy":1.025,"fear":-0.025} done'
    d = spark.createDataFrame([(whole,), (whole.replace("} done", ""),)], "t string")
    at = text.EMOTIONS.index
    got = [(r[0][at("joy")], r[0][at("fear")]) for r in d.select(text.emotion_vector(F.col("t")).alias("v")).collect()]
    size = np.hypot(1.025, 0.025)
    assert got[0] == pytest.approx((1.025 / size, -0.025 / size)) and got[1] == pytest.approx(got[0])


def walk_case(spark):
    rng = np.random.default_rng(11)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 30, (70, 2)).tolist() if a != b}
    edges = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", 1.0 + a % 3) for a, b in pairs], "src string, dst string, w double")
    reset = spark.createDataFrame([(q, f"n{a:02d}", 1.0) for q in range(3) for a in {b for b, _ in list(pairs)[3 * q : 3 * q + 2]}], "qid long, node string, w double")
    among = spark.createDataFrame([(f"n{a:02d}",) for a in range(0, 30, 2)], "node string")
    return edges, reset, among


def test_wanted_scores_alone_leave_a_task(spark):
    """Of a small graph only the best nodes among the asked ones are given, by steps and by push; the push makes all its rounds in one job."""
    edges, reset, among = walk_case(spark)
    ready = walk.ready(edges)
    every = {(r["qid"], r["node"]): r["score"] for r in walk.pagerank(ready, reset).collect()}
    want = {q: sorted(((round(s, 12), n) for (p, n), s in every.items() if p == q and int(n[1:]) % 2 == 0), key=lambda x: (-x[0], x[1]))[:4] for q in range(3)}
    got = walk.pagerank(ready, reset, among=among, best=walk.Best(4)).collect()
    assert len(got) == 12 and all((round(r["score"], 12), r["node"]) in want[r["qid"]] for r in got)
    pushed = walk.push(ready, reset, bound=1e-12, most=100, least=0.01, among=among)
    some = {(r["qid"], r["node"]): r["score"] for r in pushed.scores.collect()}
    assert set(some) == {k for k, s in every.items() if s >= 0.01 and int(k[1][1:]) % 2 == 0} and all(abs(every[k] - s) < 1e-5 for k, s in some.items())
    assert 5 < pushed.rounds < 100 and pushed.followed > 0


def test_resets_without_a_walk(spark, monkeypatch):
    """gr4 shows resets, for which nothing is walked and no synonym is searched."""
    for name in ("ready", "spread"):
        monkeypatch.setattr(walk, name, lambda *_, **__: pytest.fail("walked"))
    monkeypatch.setattr(graph, "synonym_edges", lambda *_, **__: pytest.fail("synonyms"))
    graphs.gr4_dense_reset(spark, "/root/testdata/sf0.001")


def test_search_keeps_the_best_over_a_threshold(spark):
    """With both k and least, no more than k keys a query leave a task and none under least, so that synonyms don't grow with the square."""
    m = np.random.default_rng(12).normal(size=(60, 3))
    m /= np.linalg.norm(m, axis=1)[:, None]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>").coalesce(1)
    got = knn.search(d.selectExpr("id AS qid", "vec AS qvec"), d, k=5, least=0.9).collect()
    want = {(i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i and m[i] @ m[j] >= 0.9), key=lambda j: -m[i] @ m[j])[:5]}
    assert {(r["qid"], r["id"]) for r in got} == want and len(want) < 300
