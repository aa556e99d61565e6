"""Queries over rankings: normalisation, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.functions import vec
from mnemograph.operators import evaluate, fusion, knn, ranking
from mnemograph.plans.fixtures import PAIRS, query_vectors, table
from mnemograph.plans.vectors import warped

QUERIES, ORACLES = {}, {}


def query(sql=None, also=()):
    def add(f):
        for name in (f.__name__, *also):
            QUERIES[name] = f
            if sql:
                ORACLES[name] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


#: Two rankings: 20 best by cosine, 20 best by mass-warped cosine. Gold: the keys of the query's label among all.
LISTS = f"""WITH {PAIRS},
a AS (SELECT qid, vec_id AS id, cos AS score, label, qlabel, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 20),
b AS (SELECT qid, vec_id AS id, cos AS score, label, qlabel, row_number() OVER (PARTITION BY qid ORDER BY (1 - cos) / (1 + (1 + vec_id % 10)), vec_id) AS rank FROM pairs QUALIFY rank <= 20),
gold AS (SELECT qid, vec_id AS id FROM pairs WHERE label = qlabel), ng AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1)"""
JOINED = LISTS + ", o AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, coalesce(a.score, 0) AS s, coalesce(b.score, 0) AS e, a.id IS NOT NULL AS in_s, b.id IS NOT NULL AS in_e FROM a FULL JOIN b ON a.qid = b.qid AND a.id = b.id)"


def first(spark, sf_dir, k=20):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return ranking.ranked(knn.search(query_vectors(spark, sf_dir), e, k=k))


def second(spark, sf_dir):
    return warped(spark, sf_dir, 20).select("qid", "id", "score", "rank")


def gold(spark, sf_dir):
    q = query_vectors(spark, sf_dir).select("qid", F.col("qlabel").alias("label"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").join(q, "label").where("id <> qid").select("qid", "id")


def classes(spark, sf_dir):
    """The same gold without its pairs."""
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return evaluate.Classes(query_vectors(spark, sf_dir).select("qid", F.col("qlabel").alias("label")), members)


@query(LISTS + " SELECT qid, id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END, 6) AS score FROM a WINDOW w AS (PARTITION BY qid)")
def wn1_min_max(spark, sf_dir):
    return first(spark, sf_dir).select("qid", "id", r6(ranking.min_max()).alias("score"))


@query(LISTS + " SELECT qid, id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-6), 6) AS score FROM a WINDOW w AS (PARTITION BY qid)")
def wn2_min_max_eps(spark, sf_dir):
    return first(spark, sf_dir).select("qid", "id", r6(ranking.min_max_eps()).alias("score"))


@query(LISTS + " SELECT qid, id, round((score - avg(score) OVER w) / stddev_pop(score) OVER w, 6) AS z, round(score / sqrt(sum(score * score) OVER w), 6) AS l2 FROM a WINDOW w AS (PARTITION BY qid)")
def wn3_z_score_l2(spark, sf_dir):
    return first(spark, sf_dir).select("qid", "id", r6(ranking.z_score()).alias("z"), r6(ranking.l2()).alias("l2"))


@query(LISTS + " SELECT qid, id, rank, 21 - rank AS weight FROM a")
def wn4_rank_numbering(spark, sf_dir):
    return first(spark, sf_dir).select("qid", "id", "rank", ranking.position_weight().alias("weight"))


@query(LISTS + " SELECT qid, id, 21 - rank AS weight FROM a WHERE rank <= 20")
def wn5_position_weight(spark, sf_dir):
    return first(spark, sf_dir).select("qid", "id", ranking.position_weight().alias("weight"))


@query(LISTS + " SELECT qid, id, rank FROM a WHERE rank <= 7")
def tk1_top_k(spark, sf_dir):
    return ranking.top_k(first(spark, sf_dir).drop("rank"), 7).select("qid", "id", "rank")


@query(LISTS + " SELECT * FROM (SELECT a.qid, a.id, round(a.score, 6) AS first_score, round(b.score, 6) AS score, row_number() OVER (PARTITION BY a.qid ORDER BY round(b.score, 6) DESC, a.id) AS rank FROM a JOIN b ON a.qid = b.qid AND a.id = b.id) WHERE rank <= 5")
def jn4_cascade_join(spark, sf_dir):
    d = fusion.cascade(first(spark, sf_dir), second(spark, sf_dir))
    return ranking.top_k(d.withColumn("score", r6("score")), 5).select("qid", "id", r6("first_score").alias("first_score"), "score", "rank")


@query(LISTS + " SELECT * FROM (SELECT a.qid, a.id, round(a.score, 6) AS first_score, round(b.score, 6) AS score, row_number() OVER (PARTITION BY a.qid ORDER BY round(b.score, 6) DESC, a.id) AS rank FROM a JOIN b ON a.qid = b.qid AND a.id = b.id WHERE a.rank <= 20) WHERE rank <= 5")
def rt8_cascade_fusion(spark, sf_dir):
    """Twenty candidates of the first stage, the five best of them by the second."""
    d = fusion.cascade(ranking.top_k(first(spark, sf_dir, 40).drop("rank"), 20), second(spark, sf_dir))
    return ranking.top_k(d.withColumn("score", r6("score")), 5).select("qid", "id", r6("first_score").alias("first_score"), "score", "rank")


@query(JOINED + " SELECT qid, id, round(s, 6) AS s, round(e, 6) AS e FROM o")
def jn5_score_outer_join(spark, sf_dir):
    return fusion.outer(first(spark, sf_dir), second(spark, sf_dir)).select("qid", "id", r6("s").alias("s"), r6("e").alias("e"))


@query(JOINED + """, n AS (SELECT *, (s - min(s) FILTER (in_s) OVER w) / (max(s) FILTER (in_s) OVER w - min(s) FILTER (in_s) OVER w + 1e-6) AS ns, (e - min(e) FILTER (in_e) OVER w) / (max(e) FILTER (in_e) OVER w - min(e) FILTER (in_e) OVER w + 1e-6) AS ne FROM o WINDOW w AS (PARTITION BY qid))
SELECT qid, id, round(0.4 * ns + 0.6 * ne, 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(0.4 * ns + 0.6 * ne, 6) DESC, id) <= 10""")
def rt9_parallel_fusion(spark, sf_dir):
    d = fusion.parallel(first(spark, sf_dir), second(spark, sf_dir)).withColumn("score", r6("score"))
    return ranking.top_k(d, 10).select("qid", "id", "score")


def pair_scores(spark, sf_dir):
    """Semantic score by cosine of the vectors, emotion score by (cosine + 1) / 2 of their first 28 dimensions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 28).alias("ev"))
    q = query_vectors(spark, sf_dir).select("qid", F.slice("qvec", 1, 28).alias("qe"))
    d = first(spark, sf_dir).join(e, "id").join(q, "qid")
    return d.select("qid", "id", F.col("score").alias("s"), ((vec.cosine(F.col("qe"), F.col("ev")) + 1) / 2).alias("e"))


EMO = LISTS + ", em AS (SELECT a.qid, a.id, a.score AS s, (list_inner_product(CAST(x.embedding AS DOUBLE[])[1:28], CAST(y.embedding AS DOUBLE[])[1:28]) / sqrt(list_inner_product(CAST(x.embedding AS DOUBLE[])[1:28], CAST(x.embedding AS DOUBLE[])[1:28]) * list_inner_product(CAST(y.embedding AS DOUBLE[])[1:28], CAST(y.embedding AS DOUBLE[])[1:28])) + 1) / 2 AS e FROM a JOIN embeddings x ON x.vec_id = a.qid JOIN embeddings y ON y.vec_id = a.id)"


@query(EMO + " SELECT qid, id, round(e, 6) AS score FROM em QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(e, 6) DESC, id) <= 5")
def tk4_overfetch_rerank(spark, sf_dir):
    """Four times as many by cosine as wanted, the best of them by the emotion score."""
    d = pair_scores(spark, sf_dir).select("qid", "id", r6("e").alias("score"))
    return ranking.top_k(d, 5).select("qid", "id", "score")


@query(EMO + """, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rs, row_number() OVER (PARTITION BY qid ORDER BY e DESC, id) AS re FROM em)
SELECT qid, id, round(CASE WHEN s > 0 AND e > 0 THEN 1 / (0.6 / s + 0.4 / e) ELSE 0 END, 6) AS harmonic, round(0.6 * s + 0.4 * e, 6) AS linear, round(CASE WHEN s > 0 AND e > 0 THEN pow(s, 0.6) * pow(e, 0.4) ELSE 0 END, 6) AS geometric, round(1.0 / (60 + rs) + 1.0 / (60 + re), 6) AS rank_fusion FROM r""")
def rt10_emotion_rerank(spark, sf_dir):
    d = pair_scores(spark, sf_dir)
    d = ranking.ranked(ranking.ranked(d, "s", name="rank_s"), "e", name="rank_e")
    cols = [r6(fusion.fused(F.col("s"), F.col("e"), 0.4, s, F.col("rank_s"), F.col("rank_e"))).alias(s) for s in fusion.STRATEGIES]
    return d.select("qid", "id", *cols)


LONG = f"""WITH {PAIRS}, a AS (SELECT qid, vec_id AS id, cos AS score, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 200),
gold AS (SELECT qid, vec_id AS id FROM pairs WHERE label = qlabel), ng AS (SELECT qid, count(*) AS n_gold FROM gold GROUP BY 1)"""


@query(LONG + f", h AS (SELECT a.qid, a.rank FROM a SEMI JOIN gold ON gold.qid = a.qid AND gold.id = a.id) SELECT k, round(avg(coalesce(c, 0) / n_gold), 4) AS recall FROM (SELECT unnest({evaluate.CUTS}) AS k) ks CROSS JOIN ng LEFT JOIN (SELECT qid, k, count(*) AS c FROM h JOIN (SELECT unnest({evaluate.CUTS}) AS k) ON rank <= k GROUP BY ALL) c USING (qid, k) GROUP BY k")
def ag11_retrieval_recall(spark, sf_dir):
    return evaluate.recall_at(first(spark, sf_dir, max(evaluate.CUTS)), classes(spark, sf_dir))


@query(LISTS + " SELECT a.qid, a.id FROM a SEMI JOIN gold ON gold.qid = a.qid AND gold.id = a.id")
def so2_intersection(spark, sf_dir):
    """Results that are gold."""
    return first(spark, sf_dir).select("qid", "id").intersect(gold(spark, sf_dir).select("qid", "id"))


def answer_pairs(spark, sf_dir):
    """Each turn as an answer, the next turn of the conversation as gold (itself for the last)."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf_dir, "conversations").withColumn("other", F.lead("text").over(w)).where("text IS NOT NULL")
    qid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5(F.col("text").cast("binary")))
    return c.select(qid.alias("qid"), F.col("text").alias("answer"), F.coalesce("other", "text").alias("gold"))


@query("""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS other FROM conversations), pr AS (SELECT conv_id || '-' || turn || '-' || md5(text) AS qid, lower(text) AS a, lower(coalesce(other, text)) AS g FROM c WHERE text IS NOT NULL)
SELECT qid, CAST(max(CASE WHEN a = g THEN 1 ELSE 0 END) AS DOUBLE) AS em FROM pr GROUP BY qid""")
def ag12_exact_match(spark, sf_dir):
    return evaluate.exact_match(answer_pairs(spark, sf_dir))


TOKENS = """t AS (SELECT conv_id || '-' || turn || '-' || md5(text) AS qid, row_number() OVER () AS r, text AS a, coalesce(other, text) AS g FROM c WHERE text IS NOT NULL),
w AS (SELECT qid, r, [x for x in string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(a), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if x <> ''] AS a, [x for x in string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(g), '[[:punct:]]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' ') if x <> ''] AS g FROM t),
x AS (SELECT qid, r, unnest(a) AS y FROM w), z AS (SELECT qid, r, unnest(g) AS y FROM w), m AS (SELECT r, sum(least(n, k)) AS common FROM (SELECT r, y, count(*) AS n FROM x GROUP BY ALL) JOIN (SELECT r, y, count(*) AS k FROM z GROUP BY ALL) USING (r, y) GROUP BY r),
f AS (SELECT qid, max(CASE WHEN coalesce(common, 0) > 0 THEN 2 * (common / len(a)) * (common / len(g)) / (common / len(a) + common / len(g)) ELSE 0 END) AS f1, max(CASE WHEN a = g THEN 1.0 ELSE 0.0 END) AS em FROM w LEFT JOIN m USING (r) GROUP BY qid)"""
TURNS = "c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, text) AS other FROM conversations)"


@query(f"WITH {TURNS}, {TOKENS} SELECT qid, round(f1, 6) AS f1 FROM f")
def ag13_token_f1(spark, sf_dir):
    return evaluate.token_f1(answer_pairs(spark, sf_dir)).withColumn("f1", r6("f1"))


@query(LONG.replace("<= 200", "<= 30") + ", v AS (SELECT qid, count(*) AS n, min(rank) FILTER (score >= 0.3) AS f FROM a GROUP BY qid) SELECT k, round(avg(CASE WHEN coalesce(f <= k, false) AND n >= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM v, (SELECT unnest([1, 2, 5, 10, 20, 30]) AS k) GROUP BY k")
def ag14_vector_recall(spark, sf_dir):
    return evaluate.vector_recall(first(spark, sf_dir, 30), [1, 2, 5, 10, 20, 30], 0.3)


@query("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), n AS (SELECT a.vec_id, list_inner_product(a.v, a.v) AS uu, list_inner_product(b.v, b.v) AS vv, list_inner_product(a.v, b.v) AS uv FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e)),
k AS (SELECT vec_id, uv / sqrt(uu * vv) AS cos, CASE WHEN sqrt(uu) >= 1 THEN 0.99 / sqrt(uu) ELSE 1 END AS s, CASE WHEN sqrt(vv) >= 1 THEN 0.99 / sqrt(vv) ELSE 1 END AS t, uu, vv, uv FROM n)
SELECT vec_id, cos >= 0.1 AS cosine_similar, 1 / (1 + acosh(1 + 2 * (s * s * uu + t * t * vv - 2 * s * t * uv) / ((1 - s * s * uu) * (1 - t * t * vv)))) >= 1 / (1 + 10.5) AS hyperbolic_similar FROM k""")
def ag15_similarity_predicate(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = max(e.count(), 1)
    d = e.join(e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("embedding").alias("w")), "vec_id")
    return d.select("vec_id", vec.similar(F.col("embedding"), F.col("w"), "cosine", 0.1).alias("cosine_similar"), vec.similar(F.col("embedding"), F.col("w"), "hyperbolic", 10.5).alias("hyperbolic_similar"))


@query("""WITH q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS u FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT qid, vec_id AS id, list_inner_product(u, CAST(embedding AS DOUBLE[])) AS uv, list_inner_product(u, u) AS uu, list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS vv FROM q JOIN embeddings e ON e.label = qid % 10),
s AS (SELECT qid, id, uv / sqrt(uu * vv) AS cosine, CASE WHEN sqrt(uu) >= 1 THEN 0.99 / sqrt(uu) ELSE 1 END AS a, CASE WHEN sqrt(vv) >= 1 THEN 0.99 / sqrt(vv) ELSE 1 END AS b, uu, vv, uv FROM p)
SELECT qid, id FROM s WHERE cosine >= 0.05 AND acosh(1 + 2 * (a * a * uu + b * b * vv - 2 * a * b * uv) / ((1 - a * a * uu) * (1 - b * b * vv))) <= 10.55""")
def ud3_pluggable_similarity(spark, sf_dir):
    """Vectors of one label that are similar to a query by both measures: a search by cosine, then the other measure from the pair's cosine and lengths."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    q = query_vectors(spark, sf_dir)
    size = e.select(F.col("vec_id").alias("id"), "label", vec.sq_norm(F.col("embedding")).alias("vv"))
    near = knn.search(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), least=0.05, itself=True)
    d = near.join(size, "id").join(q.select("qid", vec.sq_norm(F.col("qvec")).alias("uu")), "qid").where(F.col("label") == F.col("qid") % 10)
    return d.where(vec.hyperbolic_near(F.col("uu"), F.col("vv"), F.col("score") * F.sqrt(F.col("uu") * F.col("vv")), 10.55)).select("qid", "id")


METRICS = """, j AS (SELECT l.qid, l.rank, CASE WHEN g.id IS NULL THEN 0 ELSE 1 END AS hit FROM {src} l LEFT JOIN gold g ON g.qid = l.qid AND g.id = l.id WHERE l.rank <= 10),
s AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS seen FROM j), m AS (SELECT s.qid, coalesce(1.0 / min(rank) FILTER (hit = 1), 0) AS mrr, sum(hit * seen / rank) / any_value(n_gold) AS map, sum(hit / log2(rank + 1.0)) / list_sum([1 / log2(i + 1.0) for i in range(1, least(any_value(n_gold), 10) + 1)]) AS ndcg, sum(hit) / 10.0 AS p, sum(hit) / any_value(n_gold) AS r FROM s JOIN ng USING (qid) GROUP BY s.qid)
SELECT qid, round(mrr, 6) AS mrr, round(map, 6) AS map, round(ndcg, 6) AS ndcg, round(p, 6) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m"""


@query(LISTS + METRICS.format(src="a"))
def ag16_rank_metrics(spark, sf_dir):
    d = evaluate.rank_metrics(first(spark, sf_dir), classes(spark, sf_dir), 10)
    return d.select("qid", *(r6(c).alias(c) for c in ("mrr", "map", "ndcg", "precision", "f1")))


@query(LISTS + """, c AS (SELECT a.qid, a.id, a.rank AS ra, b.rank AS rb FROM a JOIN b ON a.qid = b.qid AND a.id = b.id) SELECT x.qid, round(sum(sign(x.ra - y.ra) * sign(x.rb - y.rb)) / count(*), 6) AS tau FROM c x JOIN c y ON x.qid = y.qid AND x.id < y.id GROUP BY x.qid""")
def ag17_kendall_tau(spark, sf_dir):
    return evaluate.kendall_tau(first(spark, sf_dir), second(spark, sf_dir)).withColumn("tau", r6("tau"))


@query(LISTS + " SELECT g.qid, g.id, CAST(coalesce(a.rank, 0) AS BIGINT) AS position, coalesce(a.rank <= 1, false) AS top1, coalesce(a.rank <= 3, false) AS top3, coalesce(a.rank <= 5, false) AS top5 FROM gold g LEFT JOIN a ON a.qid = g.qid AND a.id = g.id")
def ag17_gold_rank(spark, sf_dir):
    return evaluate.gold_ranks(first(spark, sf_dir), classes(spark, sf_dir)).withColumn("position", F.coalesce("position", F.lit(0)))


@query(LISTS + " SELECT g.qid, g.id, a.rank AS position FROM gold g JOIN a ON a.qid = g.qid AND a.id = g.id WHERE a.rank > 3")
def flt10_hard_negatives(spark, sf_dir):
    return evaluate.judged(first(spark, sf_dir), classes(spark, sf_dir)).where("hit = 1 AND rank > 3").select("qid", "id", F.col("rank").alias("position"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:28] AS t, CAST(embedding AS DOUBLE[])[29:56] AS p FROM embeddings), x AS (SELECT vec_id, list_position(t, list_max(t)) AS top, p FROM e) SELECT vec_id, len([z for z in p if z > p[top]]) < 1 AS hit1, len([z for z in p if z > p[top]]) < 3 AS hit3, len([z for z in p if z > p[top]]) < 5 AS hit5 FROM x""")
def ag18_top_label_accuracy(spark, sf_dir):
    t, p = F.slice("embedding", 1, 28), F.slice("embedding", 29, 28)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(evaluate.label_hit(t, p, k).alias(f"hit{k}") for k in (1, 3, 5)))


@query(LISTS + " SELECT x.qid, round(avg(greatest(0, 0.1 - (x.score - y.score))), 6) AS loss FROM b x JOIN b y ON x.qid = y.qid AND x.rank < y.rank GROUP BY x.qid")
def ag19_margin_loss(spark, sf_dir):
    d = second(spark, sf_dir).select("qid", F.col("rank").alias("place"), "score")
    return evaluate.margin_loss(d).withColumn("loss", r6("loss"))


@query(LISTS + """, h AS (SELECT q.qid, qlabel, (SELECT count(*) FROM a SEMI JOIN gold ON gold.qid = a.qid AND gold.id = a.id WHERE a.qid = q.qid AND a.rank <= 5) AS x, (SELECT count(*) FROM b SEMI JOIN gold ON gold.qid = b.qid AND gold.id = b.id WHERE b.qid = q.qid AND b.rank <= 5) AS y FROM q)
SELECT qlabel % 2 AS part, count(*) AS n, count(*) FILTER (x > y) AS wins, count(*) FILTER (x = y) AS ties, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_a, round(avg(CASE WHEN y > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_b, round(avg(x), 6) AS mean_a, round(avg(y), 6) AS mean_b FROM h GROUP BY 1""")
def ag20_method_comparison(spark, sf_dir):
    q = query_vectors(spark, sf_dir).select("qid", (F.col("qlabel") % 2).alias("part"))
    d = evaluate.compared(q, first(spark, sf_dir), second(spark, sf_dir), classes(spark, sf_dir), "part")
    return d.select("part", "n", "wins", "ties", *(r6(c).alias(c) for c in ("hit_a", "hit_b", "mean_a", "mean_b")))


MISS = LISTS + """, c AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY list_inner_product(CAST(qvec AS DOUBLE[])[1:28], CAST(v.embedding AS DOUBLE[])[1:28]) DESC, vec_id) AS rank FROM q, embeddings v WHERE v.vec_id <> qid QUALIFY rank <= 3),
h AS (SELECT q.qid, """ + ", ".join(f"EXISTS (SELECT 1 FROM {t} JOIN gold g ON g.qid = {t}.qid AND g.id = {t}.id WHERE {t}.qid = q.qid AND {t}.rank <= 3) AS {n}" for t, n in (("a", "x"), ("b", "y"), ("c", "z"))) + """ FROM q),
s AS (SELECT qid, unnest(list_filter([CASE WHEN NOT x AND NOT y AND NOT z THEN 'all missed' END, """ + ", ".join(f"CASE WHEN {v} THEN '{n} hit' END, CASE WHEN NOT {v} AND (x OR y OR z) THEN '{n} missed' END" for v, n in (("x", "plain"), ("y", "warped"), ("z", "part"))) + """], lambda t: t IS NOT NULL)) AS bucket FROM h),
r AS (SELECT s.bucket, coalesce(d.text, '') AS question, coalesce(d.lang, '') AS answer, coalesce(d.source, '') AS chunk, coalesce(d.n_chars, 0) / 100.0 AS mass FROM s LEFT JOIN documents d ON d.doc_id = s.qid),
k AS (SELECT bucket, w, count(*) AS n FROM r, (SELECT unnest(['the', 'die', 'que', 'les']) AS w) WHERE contains(lower(question), w) GROUP BY ALL),
l AS (SELECT bucket, string_agg(w || ':' || n, ',' ORDER BY n DESC, w) AS keywords FROM k GROUP BY 1)
SELECT bucket, count(*) AS n, round(avg(length(question)), 4) AS question_chars, round(avg(length(answer)), 4) AS answer_chars, round(avg(length(chunk)), 4) AS chunk_chars, round(min(mass), 4) AS min_mass, round(avg(mass), 4) AS mean_mass, round(max(mass), 4) AS max_mass, coalesce(any_value(keywords), '') AS keywords FROM r LEFT JOIN l USING (bucket) GROUP BY bucket"""


@query(MISS)
def ag21_miss_analysis(spark, sf_dir):
    """Three methods: cosine, mass-warped, inner product of the first 28 dimensions. A query's question is the document of its number."""
    cut28 = lambda d, a, b: d.select(F.col(a), F.slice(b, 1, 28).alias(b))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    third = ranking.ranked(knn.search(cut28(query_vectors(spark, sf_dir), "qid", "qvec"), cut28(e, "id", "vec"), k=3, metric="dot"))
    sets = evaluate.miss_sets(query_vectors(spark, sf_dir).select("qid"), {"plain": first(spark, sf_dir), "warped": second(spark, sf_dir), "part": third}, classes(spark, sf_dir), 3)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"), F.col("lang").alias("answer"), F.col("source").alias("chunk"), F.col("n_chars").alias("mass"))
    rows = sets.join(d, "qid", "left").select("bucket", *(F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer", "chunk")), (F.coalesce("mass", F.lit(0)) / 100.0).alias("mass"))
    out = evaluate.set_profiles(rows, ["the", "die", "que", "les"])
    return out.select("bucket", "n", *(F.round(c, 4).alias(c) for c in ("question_chars", "answer_chars", "chunk_chars", "min_mass", "mean_mass", "max_mass")), "keywords")


@query()
def ag22_best_configuration(spark, sf_dir):
    """The setting with the best mean of each metric, of all strategies, normalisers and weights."""
    return evaluate.best_settings(fusion.grid(pair_scores(spark, sf_dir), [0.1, 0.2, 0.3, 0.4, 0.5]), classes(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id, label, user_id % 20 AS q, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN (SELECT DISTINCT user_id FROM events) ON user_id = vec_id), l AS (SELECT * FROM e WHERE vec_id % 2 = 0), r AS (SELECT * FROM e WHERE vec_id % 2 = 1)
SELECT l.q // 2 AS q, round(avg(list_inner_product(l.v, r.v) / sqrt(list_inner_product(l.v, l.v) * list_inner_product(r.v, r.v))), 6) AS sim FROM l JOIN r ON l.q // 2 = r.q // 2 GROUP BY 1""")
def ag27_set_similarity(spark, sf_dir):
    """Mean cosine over all pairs of two sets of a query."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id")).distinct()
    d = table(spark, sf_dir, "embeddings").join(users, "vec_id").select(((F.col("vec_id") % 20) / 2).cast("long").alias("q"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("vec"))
    return evaluate.set_similarity(d).withColumn("sim", r6("sim"))


@query("""WITH e AS (SELECT vec_id, user_id % 20 AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN (SELECT DISTINCT user_id FROM events) ON user_id = vec_id), t AS (SELECT g // 2 AS q, vec_id % 2 AS side, v FROM e), s AS (SELECT * FROM t WHERE NOT (q % 3 = 0 AND side = 1)),
p AS (SELECT l.q, avg(list_inner_product(l.v, r.v) / sqrt(list_inner_product(l.v, l.v) * list_inner_product(r.v, r.v))) AS sim FROM s l JOIN s r ON l.q = r.q AND l.side = 0 AND r.side = 1 GROUP BY l.q),
d AS (SELECT q, side, i, avg(v[i]) AS x FROM (SELECT q, side, v, unnest(range(1, 65)) AS i FROM t) GROUP BY q, side, i),
f AS (SELECT a.q, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) AS sim FROM d a JOIN d b ON a.q = b.q AND a.i = b.i AND a.side = 0 AND b.side = 1 GROUP BY a.q)
SELECT f.q, round(coalesce(p.sim, f.sim), 6) AS sim FROM f LEFT JOIN p ON p.q = f.q""")
def ag27_set_similarity_with_fallback(spark, sf_dir):
    """Every third query has no vectors on one side: its sides' mean vectors stand for them."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("vec_id")).distinct()
    d = table(spark, sf_dir, "embeddings").join(users, "vec_id").select(((F.col("vec_id") % 20) / 2).cast("long").alias("q"), (F.col("vec_id") % 2).alias("side"), F.col("embedding").alias("vec"))
    return evaluate.set_similarity(d.where(~((F.col("q") % 3 == 0) & (F.col("side") == 1))), d).withColumn("sim", r6("sim"))


@query(LISTS + """, x AS (SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS plain FROM a WHERE rank <= 3 GROUP BY 1), y AS (SELECT qid, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS warped FROM b WHERE rank <= 3 GROUP BY 1), g AS (SELECT qid, min(id) AS gold_id FROM gold GROUP BY 1),
ha AS (SELECT qid, true AS h FROM a WHERE rank <= 3 AND EXISTS (SELECT 1 FROM gold WHERE gold.qid = a.qid AND gold.id = a.id) GROUP BY 1), hb AS (SELECT qid, true AS h FROM b WHERE rank <= 3 AND EXISTS (SELECT 1 FROM gold WHERE gold.qid = b.qid AND gold.id = b.id) GROUP BY 1)
SELECT q.qid, g.gold_id, plain, warped, coalesce(ha.h, false) AS plain_hit, coalesce(hb.h, false) AS warped_hit FROM q LEFT JOIN g USING (qid) LEFT JOIN x USING (qid) LEFT JOIN y USING (qid) LEFT JOIN ha USING (qid) LEFT JOIN hb USING (qid)""")
def rt13_experiment_table(spark, sf_dir):
    return evaluate.experiment_table(query_vectors(spark, sf_dir), {"plain": first(spark, sf_dir), "warped": second(spark, sf_dir)}, classes(spark, sf_dir))


@query("SELECT item_id AS qid, CASE WHEN d.text IS NULL THEN 0 ELSE 1 END AS n, md5(coalesce(d.text, '')) AS hash FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37")
def jn3_gold_join(spark, sf_dir):
    """Items whose gold chunk is a document by number; the list is empty where there is none."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") * 37).alias("chunk_id"))
    d = evaluate.gold_documents(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return d.select("qid", F.size("gold").alias("n"), F.md5(F.array_join("gold", "").cast("binary")).alias("hash"))


@query(f"""{LONG}, {TURNS}, {TOKENS}, h AS (SELECT a.qid, a.rank FROM a SEMI JOIN gold ON gold.qid = a.qid AND gold.id = a.id)
SELECT 'recall@' || k AS metric, round(avg(coalesce(c, 0) / n_gold), 4) AS value FROM (SELECT unnest([1, 5, 10]) AS k) ks CROSS JOIN ng LEFT JOIN (SELECT qid, k, count(*) AS c FROM h JOIN (SELECT unnest([1, 5, 10]) AS k) ON rank <= k GROUP BY ALL) n USING (qid, k) GROUP BY k UNION ALL SELECT 'em', round(avg(em), 4) FROM f UNION ALL SELECT 'f1', round(avg(f1), 4) FROM f""")
def rt14_qa_run(spark, sf_dir):
    """Recall table and answer scores of one run."""
    return evaluate.qa_run(first(spark, sf_dir), classes(spark, sf_dir), answer_pairs(spark, sf_dir), [1, 5, 10])
