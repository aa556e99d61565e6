"""Queries over vectors and particles: filters, scalar functions, search, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.functions import decay, vec
from mnemograph.operators import knn, ranking, retrieve
from mnemograph.plans.fixtures import DOT, GAMMA, NOW, PAIRS, PARTICLES, particles, query_vectors, table

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def keys_of(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


LEAST = 0.2


@query(f"WITH {PAIRS} SELECT qid, vec_id AS id, round(cos, 6) AS score FROM pairs WHERE cos >= 0.2")
def flt1_semantic_cone(spark, sf_dir):
    return retrieve.cone(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), LEAST).withColumn("score", r6("score"))


STATE = f"WITH {PARTICLES}, st AS (SELECT *, least(initial_radius * exp(-age / 86400 / mass), 10000.0) AS radius FROM particles)"


@query(f"{STATE} SELECT id, round(radius, 6) AS radius, round(radius / initial_radius, 6) AS strength FROM st WHERE radius >= 1e-3")
def flt2_not_forgotten(spark, sf_dir):
    d = retrieve.state(particles(spark, sf_dir), NOW, GAMMA).where("NOT forgotten")
    return d.select("id", r6("radius").alias("radius"), r6("strength").alias("strength"))


@query(f"""WITH {PAIRS}, m AS (SELECT vec_id AS id, 1 + vec_id % 7 AS mass, 1 + vec_id % 3 AS temp FROM embeddings),
t AS (SELECT qid, vec_id AS id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 20)
SELECT qid, id, round(cos, 6) AS score, rank FROM t JOIN m USING (id) WHERE mass >= 3 AND temp <= 2""")
def flt3_filter_after_knn(spark, sf_dir):
    top = ranking.ranked(knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=20))
    attrs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 7).alias("mass"), (1 + F.col("vec_id") % 3).alias("temp"))
    return top.join(attrs, "id").where("mass >= 3 AND temp <= 2").select("qid", "id", r6("score").alias("score"), "rank")


@query(f"{STATE} SELECT id, round(radius, 6) AS radius FROM st WHERE radius > 0.5 AND radius < 5")
def flt4_spherical_shell(spark, sf_dir):
    d = retrieve.state(particles(spark, sf_dir), NOW, GAMMA)
    return d.where("radius > 0.5 AND radius < 5").select("id", r6("radius").alias("radius"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(sqrt(list_sum([(x / n) * (x / n) for x in v])), 6) AS unit_norm, round(v[1] / n, 6) AS first FROM n""")
def sc1_l2_normalise(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").withColumn("u", vec.unit(F.col("embedding")))
    return d.select("vec_id", r6(vec.norm(F.col("embedding"))).alias("norm"), r6(vec.norm(F.col("u"))).alias("unit_norm"), r6(F.col("u")[0]).alias("first"))


HALF = """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) * 0.5 for x in embedding] AS v FROM embeddings),
f AS (SELECT a.vec_id, a.v AS u, b.v AS w, list_inner_product(a.v, a.v) AS uu, list_inner_product(b.v, b.v) AS ww, list_inner_product(a.v, b.v) AS uw
      FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e))"""


def halves(spark, sf_dir):
    """Each vector at half length with the next one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vec.scaled(F.col("embedding"), F.lit(0.5)).alias("u"))
    n = e.count()
    return e.join(e.select(F.pmod(F.col("vec_id") - 1, F.lit(max(n, 1))).alias("vec_id"), F.col("u").alias("w")), "vec_id")


@query(HALF + " SELECT vec_id, round(2 / (1 - uu), 6) AS factor FROM f")
def sc2_conformal_factor(spark, sf_dir):
    return halves(spark, sf_dir).select("vec_id", r6(vec.conformal_factor(F.col("u"))).alias("factor"))


@query(HALF + """, k AS (SELECT *, 1 + 2 * uw + uu * ww + 1e-8 AS d FROM f), s AS (SELECT *, (1 + 2 * uw + ww) / d AS a, (1 - uu) / d AS b FROM k)
SELECT vec_id, round(a * u[1] + b * w[1], 6) AS first, round(sqrt(a * a * uu + 2 * a * b * uw + b * b * ww), 6) AS norm FROM s""")
def sc3_mobius_add(spark, sf_dir):
    d = halves(spark, sf_dir).withColumn("s", vec.mobius_add(F.col("u"), F.col("w")))
    return d.select("vec_id", r6(F.col("s")[0]).alias("first"), r6(vec.norm(F.col("s"))).alias("norm"))


@query(HALF + """, k AS (SELECT *, 1 - 2 * uw + uu * ww + 1e-8 AS d FROM f), s AS (SELECT *, (1 - 2 * uw + ww) / d AS a, (1 - uu) / d AS b FROM k)
SELECT vec_id, round(2 * atanh(least(sqrt(greatest(a * a * uu - 2 * a * b * uw + b * b * ww, 0)), 1 - 1e-8)), 6) AS distance FROM s""")
def sc4_poincare_distance(spark, sf_dir):
    d = halves(spark, sf_dir)
    u, w = F.col("u"), F.col("w")
    return d.select("vec_id", r6(vec.poincare_distance(vec.sq_norm(u), vec.sq_norm(w), vec.dot(u, w))).alias("distance"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, 1 + vec_id % 9 AS r FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e)
SELECT vec_id, round(tanh(r / 2.0), 6) AS ball_norm, round(v[1] / n * tanh(r / 2.0), 6) AS first, round(2 * atanh(tanh(r / 2.0)), 4) AS radius FROM n""")
def sc5_project_to_ball(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").withColumn("z", vec.to_ball(F.col("embedding"), (1 + F.col("vec_id") % 9).cast("double")))
    return d.select("vec_id", r6(vec.norm(F.col("z"))).alias("ball_norm"), r6(F.col("z")[0]).alias("first"), F.round(vec.hyperbolic_radius(F.col("z")), 4).alias("radius"))


PURITY = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, len(embedding) AS d FROM embeddings),
k AS (SELECT vec_id, v, d, sqrt(list_inner_product(v, v)) AS i, list_sum([abs(x) for x in v]) AS l1, list_inner_product(v, v) AS l2 FROM e),
p AS (SELECT *, greatest(l2 / (l1 * l1), 1.0 / d) AS kappa, least(greatest(l2 / (l1 * l1 + 1e-10), 1.0 / d), 1.0) AS pur FROM k)"""


@query(PURITY + """ SELECT vec_id, round(i, 6) AS intensity, round(kappa, 6) AS purity, round(greatest(i + ln(1 + kappa), 0.01), 6) AS mass,
round(least(1 / kappa, 1e6), 5) AS temperature, round(greatest(i + ln(1 + kappa), 0.01), 6) AS radius FROM p""")
def sc6_particle_properties(spark, sf_dir):
    e = F.col("embedding")
    d = table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(e).alias("i"), vec.purity(e).alias("k"))
    mass = decay.mass_of(F.col("i"), F.col("k"))
    return d.select("vec_id", r6("i").alias("intensity"), r6("k").alias("purity"), r6(mass).alias("mass"), F.round(decay.temperature_of(F.col("k")), 5).alias("temperature"), r6(mass).alias("radius"))


@query(PURITY + """ SELECT vec_id, round(pur, 6) AS purity, round(least(greatest((pur - 1.0 / d) / (1 - 1.0 / d + 1e-10), 0), 1), 6) AS normalised,
round(-list_sum([CASE WHEN abs(x) / l1 > 1e-10 THEN abs(x) / l1 * ln(abs(x) / l1) ELSE 0 END for x in v]), 6) AS entropy FROM p""")
def sc7_purity_entropy(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(vec.clipped_purity(e)).alias("purity"), r6(vec.normalised_purity(e)).alias("normalised"), r6(vec.entropy(e)).alias("entropy"))


@query(PURITY + """, q AS (SELECT *, least(greatest((pur - 1.0 / d) / (1 - 1.0 / d + 1e-10), 0), 1) AS np FROM p)
SELECT vec_id, round(0.1 + 0.9 * (1 - np), 6) AS temperature, round(i * (1 + 0.5 * np), 6) AS speed, round(86400 * (1 + np), 3) AS tau_v, round(86400 * (1 + 2 * np), 3) AS tau_t FROM q""")
def sc8_temperature_speed_tau(spark, sf_dir):
    e = F.col("embedding")
    d = table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(e).alias("i"), vec.normalised_purity(e).alias("p"))
    p = F.col("p")
    return d.select("vec_id", r6(decay.linear_temperature(p)).alias("temperature"), r6(decay.speed(F.col("i"), p)).alias("speed"), F.round(decay.time_constant(p, 1.0), 3).alias("tau_v"), F.round(decay.time_constant(p, 2.0), 3).alias("tau_t"))


@query("""WITH x AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)),
m AS (SELECT label, i, avg(x) AS mu FROM x GROUP BY ALL), e AS (SELECT vec_id, sum((x - mu) * (x - mu)) / 2 AS energy FROM x JOIN m USING (label, i) GROUP BY vec_id),
p AS (SELECT vec_id, embedding, list_sum([abs(CAST(z AS DOUBLE)) for z in embedding]) AS l1 FROM embeddings)
SELECT vec_id, round(energy, 6) AS energy, round(energy + list_sum([CASE WHEN abs(CAST(z AS DOUBLE)) / l1 > 1e-10 THEN abs(CAST(z AS DOUBLE)) / l1 * ln(abs(CAST(z AS DOUBLE)) / l1) ELSE 0 END for z in embedding]), 6) AS free_energy
FROM e JOIN p USING (vec_id)""")
def sc9_free_energy(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    d = table(spark, sf_dir, "embeddings")
    means = d.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector(vec.doubles(F.col("embedding"))))).alias("mu"))
    d = d.join(F.broadcast(means), "label")  # one row per label
    gap = F.zip_with(vec.doubles(F.col("embedding")), F.col("mu"), lambda x, m: x - m)
    d = d.select("vec_id", (vec.sq_norm(gap) / 2).alias("energy"), vec.entropy(F.col("embedding")).alias("s"))
    return d.select("vec_id", r6("energy").alias("energy"), r6(F.col("energy") - F.col("s")).alias("free_energy"))


@query(f"{STATE} SELECT id, round(age, 1) AS age, round(radius, 6) AS radius, round(radius / initial_radius, 6) AS strength, round(mass * 86400 * ln(initial_radius / 1e-3), 3) AS time_to_forget, round(tanh(radius / 2), 6) AS ball_norm FROM st")
def sc10_decay_state(spark, sf_dir):
    d = retrieve.state(particles(spark, sf_dir), NOW, GAMMA)
    left = decay.time_to_forget(F.col("initial_radius"), F.col("mass"), GAMMA)
    return d.select("id", F.round("age", 1).alias("age"), r6("radius").alias("radius"), r6("strength").alias("strength"), F.round(left, 3).alias("time_to_forget"), r6(vec.ball_norm(F.col("radius"))).alias("ball_norm"))


@query(f"{STATE} SELECT id, round(tanh(radius / 2) * direction[1] / sqrt(list_inner_product(direction, direction)), 6) AS x1, round(tanh(radius / 2) * direction[2] / sqrt(list_inner_product(direction, direction)), 6) AS x2 FROM st")
def sc11_particle_projection(spark, sf_dir):
    d = retrieve.state(particles(spark, sf_dir), NOW, GAMMA).withColumn("z", vec.to_ball(F.col("direction"), F.col("radius")))
    return d.select("id", r6(F.col("z")[0]).alias("x1"), r6(F.col("z")[1]).alias("x2"))


@query("SELECT event_id, round(1 + 50 * value / 490.0, 6) AS modulus, CASE WHEN 1 + 50 * value / 490.0 < 10 THEN 'gas' WHEN 1 + 50 * value / 490.0 >= 40 THEN 'solid' ELSE 'liquid' END AS phase FROM events")
def sc12_modulus_phase(spark, sf_dir):
    m = decay.modulus(F.col("value") / 490.0)
    return table(spark, sf_dir, "events").select("event_id", r6(m).alias("modulus"), decay.phase(m).alias("phase"))


@query("SELECT event_id, round(least(ln(value + 1) / ln(1001.0), 1.0), 6) AS surprisal, round(least(greatest(0.7 * (value / 500) + 0.3 * least(ln(value + 1) / ln(1001.0), 1.0), 0), 1), 6) AS mass FROM events")
def sc13_chunk_mass(spark, sf_dir):
    s = decay.surprisal(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", r6(s).alias("surprisal"), r6(decay.chunk_mass(F.col("value") / 500, s)).alias("mass"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:28] AS v FROM embeddings)
SELECT vec_id, round(0.3 * len([x for x in v if abs(x) > 1e-6]) / 28 + 0.4 * list_max(v) - 0.3 * list_sum([greatest(x, 1e-10) * ln(greatest(x, 1e-10)) for x in v]) / ln(28), 6) AS quality FROM e""")
def sc14_vector_quality(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(decay.vector_quality(F.slice("embedding", 1, 28))).alias("quality"))


@query("""WITH e AS (SELECT vec_id, [least(greatest(coalesce(CAST(embedding[i] AS DOUBLE), 0), 0), 1) for i in range(1, 29)] AS v FROM (SELECT vec_id, embedding[1 : 20 + vec_id % 20] AS embedding FROM embeddings))
SELECT vec_id, len(v) AS dims, round(sqrt(list_inner_product(v, v)), 6) AS intensity, round(list_sum(v), 6) AS total, round(CASE WHEN list_sum(v) > 0 THEN list_max(v) / list_sum(v) ELSE 1 / 28.0 END, 6) AS top_share FROM e""")
def sc15_soft_label_repair(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("slice(embedding, 1, CAST(20 + vec_id % 20 AS INT))").alias("v"))
    d = d.select("vec_id", decay.repaired_label(F.col("v")).alias("s"), decay.repaired_label(F.col("v"), soft=False).alias("h"))
    return d.select("vec_id", F.size("s").cast("long").alias("dims"), r6(vec.norm(F.col("s"))).alias("intensity"), r6(vec.total(F.col("s"))).alias("total"), r6(F.array_max("h")).alias("top_share"))


@query(f"""WITH {PARTICLES} SELECT id, h * 3600 AS dt, round(initial_radius * exp(-h / 24.0 / mass), 6) AS radius, round(exp(-h / 24.0 / mass), 6) AS strength,
round(mass * exp(-h * 3600 / 86400.0), 6) AS speed, round(0.1 + (temperature - 0.1) * exp(-h * 3600 / 86400.0), 6) AS temperature, round(mass * 86400 * (1 - exp(-h * 3600 / 86400.0)), 3) AS distance
FROM particles, range(0, 241, 48) t(h)""")
def sc16_decay_curves(spark, sf_dir):
    d = particles(spark, sf_dir).select("id", "mass", "temperature", "initial_radius", F.explode(F.sequence(F.lit(0), F.lit(240), F.lit(48))).alias("h"))
    dt = F.col("h").cast("long") * 3600
    radius = decay.radius_at(F.col("initial_radius"), F.col("mass"), dt.cast("double"), GAMMA)
    fade = F.exp(-dt / 86400.0)
    return d.select("id", dt.alias("dt"), r6(radius).alias("radius"), r6(decay.strength(radius, F.col("initial_radius"))).alias("strength"), r6(F.col("mass") * fade).alias("speed"), r6(0.1 + (F.col("temperature") - 0.1) * fade).alias("temperature"), F.round(F.col("mass") * 86400 * (1 - fade), 3).alias("distance"))


TWO = "WITH m AS (SELECT event_id, user_id, value / 50 AS n0 FROM events), c AS (SELECT *, CASE WHEN n0 > 3 THEN (n0 - 3) * 0.8 + 3 ELSE 0 END AS core FROM m), s AS (SELECT *, core + (n0 - core) * exp(-0.1 * (event_id % 200)) AS raw FROM c), l AS (SELECT *, CASE WHEN raw < 1e-3 THEN 0 ELSE raw END AS norm FROM s)"


def memories(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 50).alias("n0"))
    m = m.withColumn("core", decay.core_norm(F.col("n0")))
    return m.withColumn("norm", decay.two_layer_norm(F.col("n0"), F.col("core"), (F.col("event_id") % 200).cast("double")))


@query(TWO + " SELECT event_id, round(core, 6) AS core, round(norm, 6) AS norm, norm > 0 AS alive FROM l")
def sc17_two_layer_decay(spark, sf_dir):
    return memories(spark, sf_dir).select("event_id", r6("core").alias("core"), r6("norm").alias("norm"), (F.col("norm") > 0).alias("alive"))


@query(TWO + """ SELECT CASE WHEN norm <= 0 THEN 'dead' WHEN core > 0 THEN 'core_memory' ELSE 'short_term' END AS kind, count(*) AS total, count(*) FILTER (norm > 0) AS alive,
count(*) FILTER (norm <= 0) AS dead, count(*) FILTER (norm > 0 AND core > 0) AS cores, round(coalesce(avg(norm) FILTER (norm > 0), 0), 6) AS average_norm,
round(coalesce(avg(core) FILTER (norm > 0 AND core > 0), 0), 6) AS average_core FROM l GROUP BY 1""")
def ag23_memory_status(spark, sf_dir):
    m = memories(spark, sf_dir)
    kind = F.when(F.col("norm") <= 0, "dead").when(F.col("core") > 0, "core_memory").otherwise("short_term")
    alive, core = F.col("norm") > 0, (F.col("norm") > 0) & (F.col("core") > 0)
    return m.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(~alive).alias("dead"), F.count_if(core).alias("cores"),
        r6(F.coalesce(F.avg(F.when(alive, F.col("norm"))), F.lit(0.0))).alias("average_norm"), r6(F.coalesce(F.avg(F.when(core, F.col("core"))), F.lit(0.0))).alias("average_core"),
    )


@query(TWO + """, g AS (SELECT event_id, core, n0, h AS t, core + (n0 - core) * exp(-0.1 * h) AS x FROM l, range(0, 50, 10) r(h)), z AS (SELECT *, CASE WHEN x < 1e-3 THEN 0 ELSE x END AS norm FROM g)
SELECT event_id, t, round(norm, 6) AS norm, round(norm - core, 6) AS shell, CAST(t - lag(t) OVER w AS DOUBLE) AS dt, round(norm - lag(norm) OVER w, 6) AS change FROM z WINDOW w AS (PARTITION BY event_id ORDER BY t)""")
def wn6_decay_increments(spark, sf_dir):
    from pyspark.sql import Window

    d = memories(spark, sf_dir).select("event_id", "core", "n0", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(10))).alias("t"))
    d = d.withColumn("norm", decay.two_layer_norm(F.col("n0"), F.col("core"), F.col("t").cast("double"))).withColumn("t", F.col("t").cast("long"))
    w = Window.partitionBy("event_id").orderBy("t")
    return d.select("event_id", "t", r6("norm").alias("norm"), r6(F.col("norm") - F.col("core")).alias("shell"), (F.col("t") - F.lag("t").over(w)).cast("double").alias("dt"), r6(F.col("norm") - F.lag("norm").over(w)).alias("change"))


@query(f"WITH {PAIRS} SELECT qid, vec_id AS id, round(cos, 6) AS score FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) <= 10")
def jn8_knn_join(spark, sf_dir):
    return knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=10).withColumn("score", r6("score"))


@query()
def jn8_approximate_knn(spark, sf_dir):
    """Ten neighbours from 24 of 32 lists, of which the best four keys by their codes are scored exactly."""
    return knn.approximate(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=10, lists=32, probes=24, refine=4).withColumn("score", r6("score"))


@query(f"WITH {PAIRS}, t AS (SELECT qid, vec_id AS id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 10) SELECT qid, id, round(cos, 6) AS score, rank FROM t")
def rt7_cosine_baseline(spark, sf_dir):
    return ranking.ranked(knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=10)).select("qid", "id", r6("score").alias("score"), "rank")


@query(f"""WITH {PAIRS}, t AS (SELECT qid, vec_id AS id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank FROM pairs QUALIFY rank <= 50)
SELECT qid, id, rank, round(CASE WHEN max(cos) OVER w > min(cos) OVER w THEN (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) ELSE 1 END, 6) AS score FROM t WINDOW w AS (PARTITION BY qid)""")
def rt1_dense_retrieval(spark, sf_dir):
    top = ranking.ranked(knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=50))
    return top.select("qid", "id", "rank", r6(ranking.min_max()).alias("score"))


@query(f"WITH {PAIRS} SELECT qid, vec_id AS id, round({DOT.format('qvec', 'embedding')}, 6) AS score FROM q, embeddings WHERE vec_id <> qid AND {DOT.format('qvec', 'embedding')} >= 0.1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {DOT.format('qvec', 'embedding')} DESC, vec_id) <= 5")
def rt12_inner_product_search(spark, sf_dir):
    top = knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=5, metric="dot")
    return top.where("score >= 0.1").withColumn("score", r6("score"))


@query(f"""WITH {PAIRS}, t AS (SELECT qid, vec_id AS id, cos, (1 - cos) / (1 + 10 * (1 + vec_id % 10) / 10.0) AS warped FROM pairs)
SELECT qid, id, round(cos, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY warped, id) AS rank FROM t QUALIFY rank <= 10""")
def rt6_mass_warped(spark, sf_dir):
    return warped(spark, sf_dir, 10).select("qid", "id", r6("score").alias("score"), "rank")


def warped(spark, sf_dir, k):
    """(qid, id, score, rank): best k by (1 - cos) / (1 + 10 mass); the score is the cosine."""
    keys = keys_of(spark, sf_dir).withColumn("mass", (1 + F.col("id") % 10) / 10.0)
    d = ranking.ranked(knn.search(query_vectors(spark, sf_dir), keys, k=k, metric="warped"))
    return d.withColumn("score", 1 + F.col("score") * (1 + 10 * (1 + F.col("id") % 10) / 10.0))


HYPER = f"""{STATE}, q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qvec, CAST(1 + vec_id % 4 AS DOUBLE) AS qr FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT qid, qr, v.vec_id, list_inner_product(qvec, CAST(v.embedding AS DOUBLE[])) / sqrt(list_inner_product(qvec, qvec) * {DOT.format('v.embedding', 'v.embedding')}) AS cos FROM q, embeddings v WHERE v.vec_id <> q.qid),
d AS (SELECT c.qid, st.id, st.label, st.user_id, c.cos, st.temperature, st.radius / st.initial_radius AS strength, tanh(qr / 2) AS u, tanh(st.radius / 2) AS v FROM c JOIN st USING (vec_id) WHERE cos >= 0.2 AND radius >= 1e-3),
e AS (SELECT *, u * u AS uu, v * v AS vv, u * v * cos AS uv FROM d), f AS (SELECT *, (1 - 2 * uv + vv) / (1 - 2 * uv + uu * vv + 1e-8) AS a, (1 - uu) / (1 - 2 * uv + uu * vv + 1e-8) AS b FROM e),
g AS (SELECT *, 2 * atanh(least(sqrt(greatest(a * a * uu - 2 * a * b * uv + b * b * vv, 0)), 1 - 1e-8)) AS dist FROM f), h AS (SELECT *, 1 / (dist * (1 + 1 / temperature) + 1e-8) AS score FROM g),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 10)"""


def hyperbolic(spark, sf_dir, k=retrieve.TOP_K):
    q = query_vectors(spark, sf_dir).withColumn("qradius", (1 + F.col("qid") % 4).cast("double"))
    return retrieve.hyperbolic_search(q, particles(spark, sf_dir), NOW, GAMMA, LEAST, k)


@query(HYPER + " SELECT qid, id, rank, round(score, 5) AS score, round(dist, 5) AS distance, round(cos, 6) AS cosine, temperature, round(strength, 6) AS strength FROM top")
def rt4_hyperbolic_search(spark, sf_dir):
    return hyperbolic(spark, sf_dir).select("qid", "id", "rank", F.round("score", 5).alias("score"), F.round("distance", 5).alias("distance"), r6("cosine").alias("cosine"), "temperature", r6("strength").alias("strength"))


@query(HYPER + ", w AS (SELECT qid, 'conv-' || user_id AS conversation, id, rank, count(*) OVER (PARTITION BY qid) + 1 - rank AS weight FROM top) SELECT qid, conversation, CAST(sum(weight) AS BIGINT) AS score, count(*) AS particles, string_agg(id, ',' ORDER BY rank) AS ids FROM w GROUP BY ALL")
def rt5_chunk_mode(spark, sf_dir):
    hits = hyperbolic(spark, sf_dir)
    users = particles(spark, sf_dir).select("id", F.concat(F.lit("conv-"), F.col("user_id").cast("string")).alias("conversation"))
    return retrieve.chunk_scores(hits.join(users, "id"))



@query(f"WITH {PAIRS}, t AS (SELECT qid, vec_id, label, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) AS rank, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) <= 30)) SELECT qid, label AS conversation, CAST(sum(n + 1 - rank) AS BIGINT) AS score, count(*) AS particles FROM t GROUP BY ALL")
def ag8_chunk_score(spark, sf_dir):
    """Labels as chunks of the 30 vectors nearest to a query."""
    top = ranking.ranked(knn.search(query_vectors(spark, sf_dir), keys_of(spark, sf_dir), k=30))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("conversation"))
    return retrieve.chunk_scores(top.join(labels, "id")).drop("ids")

LINKS = """WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * tanh((1 + vec_id % 6) / 4.0) for x in embedding] AS z FROM embeddings),
n AS (SELECT vec_id, z, list_inner_product(z, z) AS zz FROM e),
p AS (SELECT a.vec_id AS src, b.vec_id AS dst, acosh(1 + 2 * greatest(a.zz + b.zz - 2 * list_inner_product(a.z, b.z), 0) / ((1 - a.zz) * (1 - b.zz) + 1e-7)) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id)"""


def links(spark, sf_dir, lists=False):
    d = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), vec.unit(F.col("embedding")).alias("unit"), ((1 + F.col("vec_id") % 6) / 2).alias("radius"))
    return retrieve.hyperbolic_links(d, lists=lists)


@query(LINKS + " SELECT src, dst, round(d, 5) AS distance FROM p WHERE d < 1.5")
def jn7_hyperbolic_links(spark, sf_dir):
    return links(spark, sf_dir).withColumn("distance", F.floor(F.col("distance") * 1e5 + 0.5) / 1e5)  # as SQL rounds doubles; F.round makes a decimal of each


@query(LINKS + " SELECT src, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY round(d, 6), dst) AS links FROM p WHERE d < 1.5 GROUP BY src")
def gr6_neighbour_links(spark, sf_dir):
    return links(spark, sf_dir, lists=True).select("src", F.size("dsts").cast("long").alias("n"), F.array_join(F.col("dsts").cast("array<string>"), ",").alias("links"))
