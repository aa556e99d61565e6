"""Queries over the triples graph: edges, PageRank, graph retrieval, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemograph.operators import graph, graph_search, knn, ranking, walk
from mnemograph.plans.fixtures import DOT, PAIRS, PLACES, TRIPLES, places, query_vectors, table, triples, vector_of, with_vectors
from mnemograph.plans.vectors import HYPER, hyperbolic
from mnemograph.sources import stores

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


RAW = f"WITH {TRIPLES}"


@query("""WITH raw AS (SELECT 'chunk-' || o_orderkey AS chunk_id, [[CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus], [CAST(o_orderkey AS VARCHAR), 'status', o_orderstatus], [CAST(o_orderkey AS VARCHAR), o_orderpriority]] AS ts FROM orders)
SELECT DISTINCT chunk_id, t[1] AS s, t[2] AS p, t[3] AS o FROM (SELECT chunk_id, unnest(ts) AS t FROM raw) WHERE len(t) = 3""")
def flt5_valid_triples(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    good = F.array(key, F.lit("status"), F.col("o_orderstatus"))
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit("chunk-"), key).alias("chunk_id"), F.array(good, good, F.array(key, F.col("o_orderpriority"))).alias("triples"))
    d = graph.valid_triples(raw)
    return d.select("chunk_id", d.triple[0].alias("s"), d.triple[1].alias("p"), d.triple[2].alias("o"))


@query(f"{RAW}, m AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM triples) SELECT entity, count(*) AS chunks FROM m GROUP BY entity")
def ag1_entity_mentions(spark, sf_dir):
    return graph.mentions(triples(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("chunks"))


@query(f"{RAW} SELECT DISTINCT s, p, o FROM triples")
def ag2_distinct_facts(spark, sf_dir):
    return triples(spark, sf_dir).select("s", "p", "o").distinct()


@query(f"{RAW}, m AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM triples), t AS (SELECT DISTINCT chunk_id, s, p, o FROM triples) SELECT chunk_id, names, n FROM (SELECT chunk_id, string_agg(entity, ',' ORDER BY entity) AS names FROM m GROUP BY 1) JOIN (SELECT chunk_id, count(*) AS n FROM t GROUP BY 1) USING (chunk_id)")
def ag3_chunk_entities(spark, sf_dir):
    t = triples(spark, sf_dir)
    d = t.groupBy("chunk_id").agg(F.collect_set("s").alias("a"), F.collect_set("o").alias("b"), F.collect_set(F.struct("s", "p", "o")).alias("f"))
    return d.select("chunk_id", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("names"), F.size("f").cast("long").alias("n"))


FACTS = "fe AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT s AS src, o AS dst FROM triples UNION ALL SELECT o, s FROM triples) GROUP BY ALL)"
PASSAGES = "m AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM triples), pe AS (SELECT chunk_id AS src, entity AS dst, CAST(1 AS DOUBLE) AS w FROM m)"


@query(f"{RAW}, {FACTS} SELECT src, dst, w FROM fe")
def ag4_fact_edges(spark, sf_dir):
    return graph.fact_edges(triples(spark, sf_dir))


@query(f"{RAW}, {PASSAGES} SELECT src, dst, w FROM pe")
def ag5_passage_edges(spark, sf_dir):
    return graph.passage_edges(triples(spark, sf_dir))


@query(f"{RAW} SELECT DISTINCT s, p, o, chunk_id FROM triples")
def ag6_triple_chunks(spark, sf_dir):
    """The chunks of each fact."""
    return graph.triple_chunks(triples(spark, sf_dir))


@query(f"{RAW}, d AS (SELECT DISTINCT s, p, o, chunk_id FROM triples) SELECT s, p, o, count(*) AS chunks, min(chunk_id) AS first_chunk FROM d GROUP BY ALL")
def ag6_triple_index(spark, sf_dir):
    return graph.triple_index(triples(spark, sf_dir))


@query(f"{RAW}, {FACTS}, {PASSAGES} SELECT (SELECT count(DISTINCT entity) FROM m) AS entities, (SELECT count(DISTINCT chunk_id) FROM m) AS passages, (SELECT count(DISTINCT entity) + count(DISTINCT chunk_id) FROM m) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM triples)) AS facts, (SELECT count(*) FROM pe) AS passage_edges, CAST(0 AS BIGINT) AS synonym_edges, (SELECT count(*) FROM fe WHERE src <> dst) + (SELECT count(*) FROM pe) AS edges")
def ag7_graph_statistics(spark, sf_dir):
    return graph.statistics(triples(spark, sf_dir))


@query(f"{RAW}, {FACTS}, {PASSAGES}, n AS (SELECT DISTINCT entity AS id, 'entity' AS kind FROM m UNION ALL SELECT DISTINCT chunk_id, 'passage' FROM m), e AS (SELECT * FROM fe UNION ALL SELECT * FROM pe) SELECT k.kind, k.n AS nodes, coalesce(d.edges, 0) AS edges, coalesce(d.w, 0) AS weight FROM (SELECT kind, count(*) AS n FROM n GROUP BY 1) k LEFT JOIN (SELECT kind, count(*) AS edges, sum(w) AS w FROM e JOIN n ON n.id = e.src WHERE src <> dst GROUP BY 1) d USING (kind)")
def gr1_graph_build(spark, sf_dir):
    nodes, edges = graph.build(triples(spark, sf_dir))
    n = nodes.groupBy("kind").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("kind").agg(F.count("*").alias("edges"), F.sum("w").alias("weight"))
    return n.join(e, "kind", "left").select("kind", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query(f"{RAW}, {FACTS}, n AS (SELECT DISTINCT s AS id FROM triples WHERE p IN ('in nation', 'in region') UNION SELECT DISTINCT o FROM triples WHERE p IN ('in nation', 'in region')) SELECT src, dst, w FROM fe WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def jn6_edge_validity(spark, sf_dir):
    """Fact edges between places and those who live there alone."""
    t = triples(spark, sf_dir)
    nodes = t.where("p IN ('in nation', 'in region')").select(F.explode(F.array("s", "o")).alias("id")).distinct()
    return graph.valid_edges(graph.fact_edges(t), nodes)


def entities(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("entity "), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vec"))


SYN = "e AS (SELECT vec_id AS id, 'entity ' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings), sy AS (SELECT a.id AS src, b.id AS dst, list_inner_product(a.v, b.v) / (a.n * b.n) AS w FROM e a JOIN e b ON a.id <> b.id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) / (a.n * b.n) DESC, b.id) <= 101)"


@query(f"WITH {SYN} SELECT src, dst, round(w, 6) AS w FROM sy")
def gr2_synonym_edges(spark, sf_dir):
    return graph.synonym_edges(entities(spark, sf_dir), least=0.3).withColumn("w", r6("w"))


@query(f"WITH {SYN.replace('<= 101', '<= 2')} SELECT src, dst, round(w, 6) AS w FROM sy")
def tk5_synonym_cut(spark, sf_dir):
    """At most two neighbours: most entities have more over the bound."""
    return graph.synonym_edges(entities(spark, sf_dir), least=0.3, most=2).withColumn("w", r6("w"))


NAMES = "CASE WHEN vec_id % 7 = 0 THEN 'a-' || vec_id % 10 WHEN vec_id % 11 = 0 THEN '' ELSE 'entity ' || vec_id END"
ELIGIBLE = SYN.replace("'entity ' || vec_id AS name", f"{NAMES} AS name").replace("ON a.id <> b.id", "ON a.id <> b.id AND length(regexp_replace(a.name, '[^A-Za-z0-9]', '', 'g')) > 2 AND length(b.name) > 0")


@query(f"WITH {ELIGIBLE} SELECT src, dst, round(w, 6) AS w FROM sy")
def flt11_synonym_eligibility(spark, sf_dir):
    """Every seventh name has two characters that count, every eleventh is empty: neither looks for synonyms, and an empty one is none."""
    return graph.synonym_edges(entities(spark, sf_dir).withColumn("name", F.expr(NAMES.replace("vec_id", "id"))), least=0.3).withColumn("w", r6("w"))


def reset_regions(t):
    """One query per region: its name's node."""
    return t.where("p = 'in region'").select(F.col("o").alias("qid"), F.col("o").alias("node")).distinct().withColumn("w", F.lit(1.0))


def pagerank_sql(steps: int, damping: float = 0.5) -> str:
    ctes = [
        TRIPLES, FACTS, PASSAGES,
        "e AS (SELECT * FROM fe WHERE src <> dst UNION ALL SELECT * FROM pe)",
        "b AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY ALL)",
        "wk AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM b)",
        "r AS MATERIALIZED (SELECT DISTINCT o AS qid, o AS node, CAST(1 AS DOUBLE) AS r FROM triples WHERE p = 'in region')",
        "x0 AS (SELECT qid, node, r AS x FROM r)",
    ]
    for i in range(1, steps + 1):
        ctes.append(f"x{i} AS MATERIALIZED (SELECT qid, node, sum(f) AS x FROM (SELECT qid, dst AS node, {damping} * x * p AS f FROM x{i - 1} JOIN wk ON node = src UNION ALL SELECT qid, node, r * {1 - damping} FROM r) GROUP BY ALL)")
    return "WITH " + ",\n".join(ctes)


STEPS = graph.STEPS


@query(pagerank_sql(STEPS) + f" SELECT qid, node, round(x, 6) AS score FROM x{STEPS} WHERE node LIKE 'chunk-%' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(x, 9) DESC, node) <= 200")
def gr3_personalised_pagerank(spark, sf_dir):
    t = triples(spark, sf_dir)
    _, edges = graph.build(t)
    chunks = t.select(F.col("chunk_id").alias("node")).distinct()
    scores = graph.pagerank(edges, reset_regions(t), among=chunks, best=walk.Best(200, digits=9))
    return ranking.top_k(scores.withColumn("s", F.round("score", 9)), 200, "s", "node").select("qid", "node", r6("score").alias("score"))


FACT_Q = f"""{RAW}, fq AS (SELECT DISTINCT n_name AS qid, s, o, CASE WHEN s = n_name THEN 1.0 ELSE 0.5 END AS score FROM nation JOIN triples ON (s = n_name OR o = n_name)), m AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM triples),
sp AS (SELECT entity, count(*) AS c FROM m GROUP BY 1), ph AS (SELECT qid, entity AS node, avg(score / c) AS w FROM (SELECT qid, score, unnest([s, o]) AS entity FROM fq) JOIN sp USING (entity) GROUP BY ALL)"""


def nation_facts(spark, sf_dir):
    """Facts that name a nation, scored for the query that asks for it."""
    t = triples(spark, sf_dir)
    names = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_name").alias("qid")))  # 25 rows
    left = t.join(names, F.col("s") == F.col("qid")).select("qid", "s", "o", F.lit(1.0).alias("score"))
    right = t.join(names, (F.col("o") == F.col("qid")) & (F.col("s") != F.col("qid"))).select("qid", "s", "o", F.lit(0.5).alias("score"))
    return t, left.union(right).distinct()


@query(FACT_Q + " SELECT qid, node, round(w, 8) AS w FROM ph")
def ag9_phrase_score(spark, sf_dir):
    t, facts = nation_facts(spark, sf_dir)
    return graph.phrase_scores(facts, graph.mentions(t)).withColumn("w", F.round("w", 8))


@query(FACT_Q + " SELECT qid, node, CASE WHEN row_number() OVER (PARTITION BY qid ORDER BY round(w, 9) DESC, node) <= 5 THEN round(w, 8) ELSE 0 END AS w FROM ph")
def tk2_top_phrases(spark, sf_dir):
    t, facts = nation_facts(spark, sf_dir)
    w = graph.phrase_scores(facts, graph.mentions(t)).withColumn("w", F.round("w", 9))
    return graph.top_phrases(w, 5).withColumn("w", F.round("w", 8))


@query(FACT_Q + """, top AS (SELECT qid, node, round(w, 9) AS w FROM ph QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(w, 9) DESC, node) <= 5),
pas AS (SELECT DISTINCT t.qid, m.chunk_id AS node, 0.05 AS w FROM top t JOIN m ON m.entity = t.node) SELECT qid, node, round(sum(w), 7) AS w FROM (SELECT * FROM top UNION ALL SELECT * FROM pas) GROUP BY ALL""")
def gr4_fact_reset(spark, sf_dir):
    t, facts = nation_facts(spark, sf_dir)
    m = graph.mentions(t)
    top = graph.top_phrases(graph.phrase_scores(facts, m).withColumn("w", F.round("w", 9)), 5).where("w > 0")
    passages = top.join(m, F.col("node") == F.col("entity")).select("qid", F.col("chunk_id").alias("node")).distinct().withColumn("w", F.lit(graph.PASSAGE_WEIGHT))
    return top.union(passages).groupBy("qid", "node").agg(F.round(F.sum("w"), 7).alias("w"))


@query(f"WITH {PAIRS}, s AS (SELECT qid, label AS node, sum(cos) AS s FROM pairs WHERE cos > 0 GROUP BY ALL) SELECT qid, node, round(s / max(s) OVER (PARTITION BY qid), 6) AS w FROM s")
def ag10_expansion_score(spark, sf_dir):
    return graph.expansion_score(label_pairs(spark, sf_dir)).withColumn("w", r6("w"))


def label_pairs(spark, sf_dir):
    """All positive similarities, summed by label."""
    e = table(spark, sf_dir, "embeddings")
    return knn.sums(query_vectors(spark, sf_dir), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("node")))


GR5 = f"""WITH {PAIRS}, s AS (SELECT qid, label AS node, sum(cos) AS s FROM pairs WHERE cos > 0 GROUP BY ALL), x AS (SELECT qid, node, s / max(s) OVER (PARTITION BY qid) AS w FROM s),
c AS (SELECT label AS node, count(*) AS c FROM embeddings GROUP BY 1), u AS (SELECT qid, qlabel AS node, 1.0 AS w FROM q UNION ALL SELECT qid, node, w * 0.5 FROM x UNION ALL SELECT qid, node, w * 0.3 FROM x UNION ALL SELECT qid, node, w * 0.2 FROM x),
rs AS (SELECT qid, node, sum(w) / any_value(c) AS w FROM u JOIN c USING (node) GROUP BY ALL)"""


@query(GR5 + " SELECT qid, node, round(w, 6) AS w FROM rs")
def gr5_merged_reset(spark, sf_dir):
    return label_reset(spark, sf_dir).withColumn("w", r6("w"))


def label_reset(spark, sf_dir):
    x = stores.kept(graph.expansion_score(label_pairs(spark, sf_dir)), "expansion")  # it stands for three expansions
    own = query_vectors(spark, sf_dir).select("qid", F.col("qlabel").alias("node"))
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("entity"))
    return graph.merged_reset([(x, 0.5), (x, 0.3), (x, 0.2)], own, m)


@query(f"WITH {PAIRS}, t AS (SELECT qid, vec_id AS id, cos FROM pairs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY cos DESC, vec_id) <= 5) SELECT qid, id, round(CASE WHEN max(cos) OVER w > min(cos) OVER w THEN (cos - min(cos) OVER w) / (max(cos) OVER w - min(cos) OVER w) ELSE 1 END, 6) AS score FROM t WINDOW w AS (PARTITION BY qid)")
def rt2_fact_scoring(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return knn.search(query_vectors(spark, sf_dir), e, k=5).select("qid", "id", r6(ranking.min_max()).alias("score"))


def place_graph(spark, sf_dir):
    """The places graph with synonyms, from one batch."""
    t = stores.kept(places(spark, sf_dir), "places")
    names = graph.mentions(t).select(F.col("entity").alias("name")).distinct()
    return graph.extend(None, t, with_vectors(spark, sf_dir, names, "name"))


VECTORS = "vs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
#: Nodes, edges with synonyms, and the walk of the places graph.
PLACE_GRAPH = f"""{PLACES}, {VECTORS}, pm AS MATERIALIZED (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM places),
vv AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS w FROM vs a, vs b WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.8),
en AS (SELECT entity, {vector_of('entity')} AS i FROM (SELECT DISTINCT entity FROM pm)),
sy AS (SELECT a.entity AS src, b.entity AS dst, w FROM en a JOIN vv USING (i) JOIN en b ON b.i = vv.j AND a.entity <> b.entity QUALIFY row_number() OVER (PARTITION BY a.entity ORDER BY w DESC, b.entity) <= 101),
fp AS (SELECT src, dst, kind, CAST(count(*) AS DOUBLE) AS w FROM (SELECT s AS src, o AS dst, 'entity' AS kind FROM places UNION ALL SELECT o, s, 'entity' FROM places UNION ALL SELECT chunk_id, entity, 'passage' FROM pm) WHERE src <> dst GROUP BY ALL),
ge AS MATERIALIZED (SELECT src, dst, coalesce(sy.w, fp.w) AS w, coalesce(kind, 'entity') AS kind FROM fp FULL JOIN sy USING (src, dst)),
gb AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM ge UNION ALL SELECT dst, src, w FROM ge) GROUP BY ALL),
wk AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM gb)"""


def walk_sql(steps: int, name: str = "x") -> str:
    """Power steps from r(qid, node, r) over wk."""
    ctes = [f"{name}0 AS (SELECT qid, node, r AS x FROM r)"]
    ctes += [f"{name}{i} AS MATERIALIZED (SELECT qid, node, sum(f) AS x FROM (SELECT qid, dst AS node, 0.5 * x * p AS f FROM {name}{i - 1} JOIN wk ON node = src UNION ALL SELECT qid, node, r * 0.5 FROM r) GROUP BY ALL)" for i in range(1, steps + 1)]
    return ",\n".join(ctes)


@query(f"WITH {PLACE_GRAPH} SELECT src, dst, kind, round(w, 6) AS w FROM ge")
def gr1_incremental_graph(spark, sf_dir):
    """Three batches, the last of which repeats chunks: the same edges, synonyms among them, as one build."""
    t = stores.kept(places(spark, sf_dir), "places")
    names = with_vectors(spark, sf_dir, graph.mentions(t).select(F.col("entity").alias("name")).distinct(), "name")
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(5))
    g = graph.extend(None, t.where(part < 2), names)
    g = graph.extend(g, t.where((part >= 2) & (part < 4)), names)
    return graph.extend(g, t.where(part >= 3), names).edges().select("src", "dst", "kind", r6("w").alias("w"))


@query(f"WITH {PLACE_GRAPH} SELECT (SELECT count(DISTINCT entity) FROM pm) AS entities, (SELECT count(DISTINCT chunk_id) FROM pm) AS passages, (SELECT count(DISTINCT entity) + count(DISTINCT chunk_id) FROM pm) AS nodes, (SELECT count(*) FROM (SELECT DISTINCT s, p, o FROM places)) AS facts, (SELECT count(*) FROM pm) AS passage_edges, (SELECT count(*) FROM sy) AS synonym_edges, (SELECT count(*) FROM ge) AS edges")
def ag7_statistics_with_synonyms(spark, sf_dir):
    g = place_graph(spark, sf_dir)
    return graph.statistics(g.triples, g.synonyms)


@query(f"WITH {PLACE_GRAPH}, r AS (SELECT c_custkey AS qid, 'customer ' || c_custkey AS node, CAST(1 AS DOUBLE) AS r FROM customer WHERE c_custkey % 50 = 0), {walk_sql(40)} SELECT qid, node, round(x, 5) AS score FROM x40 WHERE x >= 0.002")
def gr3_local_push(spark, sf_dir):
    """Every fiftieth customer's walk, pushed until no residual is over its bound."""
    ready = walk.ready(place_graph(spark, sf_dir).edges())
    asked = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("node"), F.lit(1.0).alias("w"))
    return walk.push(ready, asked, bound=1e-10, least=0.002).scores.withColumn("score", F.round("score", 5))


def place_vectors(spark, sf_dir, triples):
    """Facts and passages with vectors by the hash of what they say."""
    facts = triples.select("s", "p", "o").distinct().select(F.concat_ws("|", "s", "p", "o").alias("id"), "s", "o")
    passages = triples.select(F.col("chunk_id").alias("id")).distinct()
    return with_vectors(spark, sf_dir, facts, "id"), with_vectors(spark, sf_dir, passages, "id")


def place_memory(spark, sf_dir, steps=STEPS):
    """The places graph for retrieval."""
    g = place_graph(spark, sf_dir)
    return g, graph_search.remember(g.triples, g.edges(), *place_vectors(spark, sf_dir, g.triples), steps=steps)


#: Facts' scores, passages' scores and the reset of each query; facts under 0.25 don't count.
RESET = f"""q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0), qd AS MATERIALIZED (SELECT qid, vec_id, list_inner_product(qv, v) AS d FROM q, vs),
ft AS (SELECT id, s, o, {vector_of('id')} AS vec_id FROM (SELECT DISTINCT s || '|' || p || '|' || o AS id, s, o FROM places)),
fs AS MATERIALIZED (SELECT qid, id, s, o, d, CASE WHEN max(d) OVER w > min(d) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 1 END AS score, row_number() OVER (PARTITION BY qid ORDER BY d DESC, id) AS rank FROM ft JOIN qd USING (vec_id) WINDOW w AS (PARTITION BY qid)),
sp AS (SELECT entity, count(*) AS c FROM pm GROUP BY 1),
pa AS (SELECT qid, entity AS node, round(avg(score / c), 12) AS w FROM (SELECT qid, score, unnest([s, o]) AS entity FROM fs WHERE rank <= 5 AND d >= 0.25) JOIN sp USING (entity) GROUP BY qid, entity),
ph AS (SELECT * FROM pa QUALIFY row_number() OVER (PARTITION BY qid ORDER BY w DESC, node) <= 5),
pt AS (SELECT DISTINCT chunk_id AS id, {vector_of('chunk_id')} AS vec_id FROM pm),
ps AS MATERIALIZED (SELECT qid, id AS node, d, CASE WHEN max(d) OVER w > min(d) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 1 END AS score FROM pt JOIN qd USING (vec_id) WINDOW w AS (PARTITION BY qid)),
r1 AS (SELECT qid, node, w FROM ph WHERE w > 0 UNION ALL SELECT qid, node, 0.05 * score FROM ps)"""


@query(f"WITH {PLACE_GRAPH}, {RESET} SELECT qid, node, round(w, 7) AS w FROM r1")
def gr4_dense_reset(spark, sf_dir):
    """Phrases of the best facts and every passage by its similarity."""
    t = stores.kept(places(spark, sf_dir), "places")
    memory = graph_search.remember(t, None, *place_vectors(spark, sf_dir, t))
    return graph_search.full_reset(query_vectors(spark, sf_dir), memory, least=0.25).withColumn("w", F.round("w", 7))


RT3 = f"""{PLACE_GRAPH}, {RESET}, r AS (SELECT qid, node, w / sum(w) OVER (PARTITION BY qid) AS r FROM r1 WHERE qid IN (SELECT qid FROM ph)), {walk_sql(STEPS)},
rt3 AS (SELECT qid, node, x AS score, 'graph' AS way FROM x{STEPS} WHERE node LIKE 'chunk-%' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(x, 12) DESC, node) <= 10
  UNION ALL SELECT qid, node, score, 'dense' FROM ps WHERE qid NOT IN (SELECT qid FROM ph) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d DESC, node) <= 10)"""


@query(f"WITH {RT3} SELECT qid, node, round(score, 7) AS score, way FROM rt3")
def rt3_graph_retrieval(spark, sf_dir):
    """Facts by similarity, reset over phrases and all passages, PageRank; plain similarity for queries without a fact over the bound."""
    found = graph_search.retrieve(query_vectors(spark, sf_dir), place_memory(spark, sf_dir)[1], k=10, least=0.25)
    return found.withColumn("score", F.round("score", 7))


@query(f"WITH {RT3.replace(walk_sql(STEPS), walk_sql(40)).replace(f'x{STEPS} WHERE', 'x40 WHERE')} SELECT qid, round(sum(score), 5) AS score, count(*) AS n, any_value(way) AS way FROM rt3 GROUP BY qid")
def rt3_local_retrieval(spark, sf_dir):
    """The same with the phrases pushed, to a bound, instead of walked over the whole graph."""
    found = graph_search.retrieve(query_vectors(spark, sf_dir), place_memory(spark, sf_dir, 40)[1], k=10, least=0.25, bound=1e-9)
    return found.groupBy("qid").agg(F.round(F.sum("score"), 5).alias("score"), F.count("*").alias("n"), F.first("way").alias("way"))


#: Query entities, and the three expansions from them, from particles and from facts.
RT11 = f"""{HYPER.replace('q AS (', 'hq AS (').replace('FROM q,', 'FROM hq,').replace('q.qid)', 'hq.qid)').replace('rank <= 10', 'rank <= 20').removeprefix('WITH ')}, {PLACE_GRAPH}, {RESET},
own AS (SELECT DISTINCT qid, unnest(['customer ' || qid, 'NATION_' || qid % 25]) AS node FROM q WHERE qid % 100 <> 0),
va AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) AS w FROM vs a, vs b WHERE a.vec_id IN (SELECT i FROM en JOIN own ON entity = node)),
se AS (SELECT own.qid, b.entity AS node, sum(w) AS s FROM own JOIN (SELECT a.entity AS src, b.entity, w FROM en a JOIN va USING (i) JOIN en b ON b.i = va.j WHERE a.entity IN (SELECT node FROM own) QUALIFY row_number() OVER (PARTITION BY a.entity ORDER BY round(w, 12) DESC, b.entity) <= 20) b ON own.node = b.src GROUP BY ALL),
eh AS (SELECT qid, 'customer ' || user_id AS node, sum(1 / (1 + dist)) AS s FROM top WHERE qid IN (SELECT qid FROM own) GROUP BY ALL),
fh AS (SELECT qid, unnest([s, o]) AS node, score FROM fs WHERE rank <= 20 AND qid IN (SELECT qid FROM own)), fx AS (SELECT qid, node, sum(score) AS s FROM fh GROUP BY ALL),
u AS (SELECT qid, node, CAST(1 AS DOUBLE) AS w FROM own UNION ALL SELECT qid, node, 0.5 * s / max(s) OVER (PARTITION BY qid) FROM se UNION ALL SELECT qid, node, 0.3 * s / max(s) OVER (PARTITION BY qid) FROM eh UNION ALL SELECT qid, node, 0.2 * s / max(s) OVER (PARTITION BY qid) FROM fx),
u1 AS (SELECT qid, node, sum(w) / any_value(c) AS w FROM u JOIN sp ON entity = node GROUP BY ALL),
r AS (SELECT qid, node, w / sum(w) OVER (PARTITION BY qid) AS r FROM u1), {walk_sql(STEPS)},
fused AS (SELECT qid, node, x AS score, 'fusion' AS way FROM x{STEPS} WHERE node LIKE 'chunk-%' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(x, 12) DESC, node) <= 5),
fr AS (SELECT qid, node, w / sum(w) OVER (PARTITION BY qid) AS r FROM r1 WHERE qid IN (SELECT qid FROM ph) AND qid NOT IN (SELECT qid FROM own)), {walk_sql(STEPS, 'y').replace('FROM r)', 'FROM fr)')},
rest AS (SELECT qid, node, x AS score, 'graph' AS way FROM y{STEPS} WHERE node LIKE 'chunk-%' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(x, 12) DESC, node) <= 5
  UNION ALL SELECT qid, node, score, 'dense' FROM ps WHERE qid NOT IN (SELECT qid FROM ph) AND qid NOT IN (SELECT qid FROM own) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d DESC, node) <= 5)"""


@query(f"WITH {RT11} SELECT qid, node, round(score, 7) AS score, way FROM fused UNION ALL SELECT qid, node, round(score, 7), way FROM rest")
def rt11_graph_fusion(spark, sf_dir):
    """Query entities with their neighbours by meaning, by emotion and by facts; every other query has no entity and is answered by graph retrieval."""
    g, memory = place_memory(spark, sf_dir)
    q = query_vectors(spark, sf_dir)
    names = F.array(F.concat(F.lit("customer "), F.col("qid").cast("string")), F.concat(F.lit("NATION_"), (F.col("qid") % 25).cast("string")))
    own = q.where("qid % 100 <> 0").select("qid", F.explode(names).alias("node"))
    users = table(spark, sf_dir, "events").select(F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("customer "), F.col("user_id").cast("string")).alias("node"))
    hits = hyperbolic(spark, sf_dir, 20).join(users, "id").select("qid", "node", "distance")
    vectors = g.entities.select(F.col("name").alias("node"), "vec")
    return graph_search.fused(q, own, hits, vectors, memory, k=5, least=0.25).withColumn("score", F.round("score", 7))


def finished(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("chunk-"), F.md5(F.col("o_orderkey").cast("string").cast("binary"))).alias("chunk_id"))


@query(f"""{RAW}, m AS (SELECT DISTINCT chunk_id, unnest([s, o]) AS entity FROM triples), dl AS (SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)) AS chunk_id FROM orders WHERE o_orderstatus = 'F'),
lf AS (SELECT * FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM dl)) SELECT entity, coalesce(chunks_left, 0) AS chunks_left FROM (SELECT DISTINCT entity FROM m) LEFT JOIN (SELECT entity, count(*) AS chunks_left FROM lf GROUP BY 1) USING (entity)""")
def jn12_delete_with_references(spark, sf_dir):
    m = graph.mentions(triples(spark, sf_dir))
    return graph.survivors(m, finished(spark, sf_dir))


@query(f"""{RAW}, {FACTS}, {PASSAGES}, dl AS (SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)) AS chunk_id FROM orders WHERE o_orderstatus = 'F'), lt AS (SELECT * FROM triples WHERE chunk_id NOT IN (SELECT chunk_id FROM dl)),
le AS (SELECT s AS id FROM lt UNION SELECT o FROM lt), n AS (SELECT id FROM le UNION SELECT chunk_id FROM lt), e AS (SELECT * FROM fe UNION ALL SELECT * FROM pe)
SELECT 'fact' AS kind, md5(s || '|' || p || '|' || o) AS id FROM (SELECT DISTINCT s, p, o FROM lt) UNION ALL SELECT 'entity', md5(id) FROM le UNION ALL SELECT 'node', md5(id) FROM n UNION ALL SELECT 'edge', md5(src || '|' || dst) FROM e WHERE src <> dst AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""")
def jn12_delete_from_graph(spark, sf_dir):
    """What is left of facts, entities, nodes and edges when the chunks of finished orders go."""
    t = triples(spark, sf_dir)
    _, edges = graph.build(t)
    left = graph.delete(t, edges, finished(spark, sf_dir))
    row = lambda kind, d, *columns: d.select(F.lit(kind).alias("kind"), F.md5(F.concat_ws("|", *columns).cast("binary")).alias("id"))
    return row("fact", left["facts"], "s", "p", "o").union(row("entity", left["entities"], "entity")).union(row("node", left["nodes"], "id")).union(row("edge", left["edges"], "src", "dst"))


@query(f"{RAW} SELECT chunk_id FROM triples EXCEPT SELECT 'chunk-' || md5(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderstatus = 'F'")
def so3_set_difference(spark, sf_dir):
    """Chunks that outlive a deletion."""
    return triples(spark, sf_dir).select("chunk_id").subtract(finished(spark, sf_dir))


@query(f"{RAW}, a AS (SELECT DISTINCT s AS entity FROM triples WHERE p = 'in nation'), b AS (SELECT DISTINCT o AS entity FROM triples WHERE p IN ('in nation', 'in region')) SELECT entity FROM a UNION SELECT entity FROM b")
def so1_entity_union(spark, sf_dir):
    t = triples(spark, sf_dir)
    return t.where("p = 'in nation'").select(F.col("s").alias("entity")).union(t.where("p IN ('in nation', 'in region')").select("o")).distinct()
