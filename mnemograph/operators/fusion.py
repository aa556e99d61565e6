"""Fusing two rankings of the same queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.operators import ranking

#: Weights of parallel fusion (graph, emotion) and of the reranker, and the rank constant; fixed values.
GRAPH_WEIGHT, EMOTION_WEIGHT, SENTIMENT_WEIGHT, RANK_CONSTANT = 0.4, 0.6, 0.4, 60

STRATEGIES = ("linear", "harmonic", "geometric", "rank_fusion")
NORMALISERS = {"min_max": ranking.min_max, "z_score": ranking.z_score, "l2": ranking.l2, "none": lambda score, key="qid": F.col(score)}


def cascade(first: DataFrame, second: DataFrame) -> DataFrame:
    """First-stage candidates that the second stage scored too, by the second score. (qid, id, score) each."""
    return first.select("qid", "id", F.col("score").alias("first_score")).join(second.select("qid", "id", "score"), ["qid", "id"])


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, id, s, e): both scores, 0 where missing."""
    x, y = a.select("qid", "id", F.col("score").alias("s")), b.select("qid", "id", F.col("score").alias("e"))
    return x.join(y, ["qid", "id"], "full").select("qid", "id", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("e", F.lit(0.0)).alias("e"), F.col("s").isNotNull().alias("in_s"), F.col("e").isNotNull().alias("in_e"))


def parallel(a: DataFrame, b: DataFrame, wa: float = GRAPH_WEIGHT, wb: float = EMOTION_WEIGHT, eps: float = 1e-6) -> DataFrame:
    """Weighted sum of min-max scores; minimum and maximum over the rows present in that source, a missing score is 0 before."""
    d = outer(a, b)
    w = ranking.per("qid")

    def norm(c: str) -> Column:
        shown = F.when(F.col("in_" + c), F.col(c))
        low, high = F.min(shown).over(w), F.max(shown).over(w)
        return F.coalesce((F.col(c) - low) / (high - low + eps), F.lit(0.0))

    return d.select("qid", "id", (wa * norm("s") + wb * norm("e")).alias("score"))


def fused(s: Column, e: Column, weight: Column | float, strategy: str, rank_s: Column | None = None, rank_e: Column | None = None) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(weight)
    if strategy == "linear":
        return (1 - w) * s + w * e
    if strategy == "harmonic":
        return F.when((s > 0) & (e > 0), 1 / ((1 - w) / s + w / e)).otherwise(F.lit(0.0))
    if strategy == "geometric":
        return F.when((s > 0) & (e > 0), F.pow(s, 1 - w) * F.pow(e, w)).otherwise(F.lit(0.0))
    return 1 / (RANK_CONSTANT + rank_s) + 1 / (RANK_CONSTANT + rank_e)


def rerank(d: DataFrame, strategy: str = "harmonic", normaliser: str = "none", weight: float = SENTIMENT_WEIGHT) -> DataFrame:
    """(qid, id, score) from (qid, id, s, e)."""
    d = ranking.ranked(ranking.ranked(d, "s", name="rank_s"), "e", name="rank_e")
    n = NORMALISERS[normaliser]
    d = d.withColumn("s", n("s")).withColumn("e", n("e"))
    return d.select("qid", "id", fused(F.col("s"), F.col("e"), weight, strategy, F.col("rank_s"), F.col("rank_e")).alias("score"))


def grid(d: DataFrame, weights: list[float]) -> DataFrame:
    """(setting, qid, id, score) for all strategies, normalisers and weights at once."""
    settings = [(s, n, w) for s in STRATEGIES for n in NORMALISERS for w in weights]
    d = ranking.ranked(ranking.ranked(d, "s", name="rank_s"), "e", name="rank_e")
    for n, f in NORMALISERS.items():
        d = d.withColumn(f"s_{n}", f("s")).withColumn(f"e_{n}", f("e"))
    one = [F.struct(F.lit(f"{s}/{n}/{w}").alias("setting"), fused(F.col(f"s_{n}"), F.col(f"e_{n}"), w, s, F.col("rank_s"), F.col("rank_e")).alias("score")) for s, n, w in settings]
    return d.select("qid", "id", F.explode(F.array(*one)).alias("x")).select("x.setting", "qid", "id", "x.score")
