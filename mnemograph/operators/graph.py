"""The entity and passage graph; walks over it are in `walk`."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemograph.operators import knn, ranking
from mnemograph.operators.walk import DAMPING, STEPS, pagerank, push, ready, spread  # noqa: F401
from mnemograph.sources import stores

#: Weight of passages in the reset vector; a fixed default.
PASSAGE_WEIGHT = 0.05
#: Neighbours of an entity by name; fixed defaults.
SYNONYM_LEAST, SYNONYM_MOST = 0.8, 101


def valid_triples(raw: DataFrame) -> DataFrame:
    """(chunk_id, triple) from (chunk_id, triples array<array<string>>): exactly three parts, first of equal ones in a chunk."""
    three = F.filter("triples", lambda t: (F.size(t) == 3) & ~F.exists(t, lambda x: x.isNull()))
    return raw.select("chunk_id", F.explode(F.array_distinct(three)).alias("triple"))


def triple_chunks(triples: DataFrame) -> DataFrame:
    """(s, p, o, chunk_id): the set of chunks of each fact as rows, none gathered."""
    return triples.select("s", "p", "o", "chunk_id").distinct()


def triple_index(triples: DataFrame) -> DataFrame:
    """(s, p, o, chunks, first_chunk): in how many chunks a fact is, and the least of them."""
    return triples.select("chunk_id", "s", "p", "o").distinct().groupBy("s", "p", "o").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first_chunk"))


def statistics(triples: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One row: entities, passages, nodes, facts, passage_edges, synonym_edges, edges (all ordered pairs of the graph)."""
    t = stores.kept(triples.select("chunk_id", "s", "p", "o"), "triples")
    m = mentions(t)
    facts = t.select("s", "p", "o").distinct().agg(F.count("*").alias("facts"))
    a = m.groupBy("entity").count().agg(F.count("*").alias("entities"), F.coalesce(F.sum("count"), F.lit(0)).alias("passage_edges"))
    b = t.select("chunk_id").distinct().agg(F.count("*").alias("passages"))
    edges = weighted(t, m)
    whole = (edges if synonyms is None else with_synonyms(edges, synonyms)).agg(F.count("*").alias("edges"))
    c = synonyms.agg(F.count("*").alias("synonym_edges")) if synonyms is not None else facts.select(F.lit(0).cast("long").alias("synonym_edges"))
    d = a.join(b, F.lit(True)).join(facts, F.lit(True)).join(c, F.lit(True)).join(whole, F.lit(True))  # one row each
    return d.select("entities", "passages", (F.col("entities") + F.col("passages")).alias("nodes"), "facts", "passage_edges", "synonym_edges", "edges")


def fact_edges(triples: DataFrame) -> DataFrame:
    """(src, dst, w): one per triple in each direction."""
    both = triples.select(F.explode(F.array(F.struct(F.col("s").alias("src"), F.col("o").alias("dst")), F.struct(F.col("o").alias("src"), F.col("s").alias("dst")))).alias("e"))
    return both.groupBy("e.src", "e.dst").agg(F.count("*").cast("double").alias("w"))


def mentions(triples: DataFrame) -> DataFrame:
    """Distinct (chunk_id, entity). Triples are dealt by chunk, once each, so that what follows by chunk needs no further shuffle."""
    return triples.select("chunk_id", "s", "o").repartition("chunk_id").select("chunk_id", F.explode(F.array("s", "o")).alias("entity")).distinct()


def passage_edges(triples: DataFrame) -> DataFrame:
    return mentions(triples).select(F.col("chunk_id").alias("src"), F.col("entity").alias("dst"), F.lit(1.0).alias("w"))


def vector_classes(entities: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """entities(id, vec) of one vector as a class, named by its least id: (id, class) of all, and (class, vec)."""
    rows = entities.where("vec IS NOT NULL").select("id", "vec")
    reps = stores.kept(rows.groupBy("vec").agg(F.min("id").alias("class")), tag)
    return rows.join(reps, "vec").select("id", "class"), reps


def neighbours(entities: DataFrame, others: DataFrame, least: float, most: int) -> DataFrame:
    """(src, dst, w): the `most` nearest others with a name of each eligible entity(id, name, vec), with cosines of `least` and more.

    Entities of one vector have the same neighbours but themselves, so distinct vectors are
    searched, and a class's best `most` + 1 are found once for all its members. They are in the best
    `most` + 1 classes, as each class before theirs has a member before them: more pairs don't leave a task.
    """
    able, asked = vector_classes(entities.where(F.length(F.regexp_replace("name", "[^A-Za-z0-9]", "")) > 2), "asked-classes")
    named, known = vector_classes(others.where(F.length("name") > 0), "classes")
    near = knn.search(asked.select(F.col("class").alias("qid"), F.col("vec").alias("qvec")), known.select(F.col("class").alias("id"), "vec"), k=most + 1, least=least, itself=True)
    first = ranking.top_k(named.withColumn("same", F.lit(0)), most + 1, "same", "id", "class").select(F.col("class").alias("other"), F.col("id").alias("dst"))
    best = ranking.top_k(near.select("qid", F.col("id").alias("other"), F.col("score").alias("w")).join(first, "other"), most + 1, "w", "dst")
    lists = best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst", "w"))), lambda x: F.struct(x["dst"].alias("dst"), x["w"].alias("w"))).alias("list"))  # `most` + 1 rows
    found = able.join(lists, F.col("class") == F.col("qid"))
    return found.select(F.col("id").alias("src"), F.inline(F.slice(F.filter("list", lambda x: x["dst"] != F.col("id")), 1, most)))


def synonym_edges(entities: DataFrame, least: float = SYNONYM_LEAST, most: int = SYNONYM_MOST) -> DataFrame:
    """(src, dst, w): per eligible entity its nearest others by cosine. entities(id, name, vec), ids of any type."""
    return neighbours(entities, entities, least, most)


def with_synonyms(edges: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(src, dst, w, kind): a synonym's weight replaces a fact's on the same ordered pair. edges(src, dst, w, kind)."""
    s = synonyms.select("src", "dst", F.col("w").alias("syn"))
    return edges.join(s, ["src", "dst"], "full").select("src", "dst", F.coalesce("syn", "w").alias("w"), F.coalesce("kind", F.lit("entity")).alias("kind"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between known nodes, without loops."""
    e = edges.where("src <> dst")
    return e.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")


def weighted(triples: DataFrame, mentions_: DataFrame) -> DataFrame:
    """(src, dst, kind, w) of facts and mentions, without loops: both ends of each are mentions, so nothing else can be invalid."""
    ends = triples.where("s <> o").groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.count("*").cast("double").alias("w"))  # both directions weigh the same
    facts = ends.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "w")
    passages = mentions_.where("chunk_id <> entity").select("chunk_id", "entity", F.lit("passage").alias("kind"), F.lit(1.0).alias("w"))  # distinct already
    return facts.select("e.src", "e.dst", F.lit("entity").alias("kind"), "w").union(passages)


def build(triples: DataFrame, synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes(id, kind) and undirected edges(src, dst, w, kind) of facts, passages and synonyms; an edge's kind is its source's.

    A fact pair is stored in both directions and both become edges, so its weight
    counts twice against a passage edge's; a synonym's weight replaces it. Triples are
    computed once and stored.
    """
    t = stores.kept(triples.select("chunk_id", "s", "o"), "triples")
    entities = t.select(F.explode(F.array("s", "o")).alias("id")).distinct().withColumn("kind", F.lit("entity"))
    nodes = entities.union(t.select("chunk_id").distinct().withColumn("kind", F.lit("passage")))
    edges = weighted(t, mentions(t))
    return nodes, (edges if synonyms is None else with_synonyms(edges, synonyms)).select("src", "dst", "w", "kind")


class Graph(NamedTuple):
    """An indexed corpus that grows by batches; all tables stored, old parts never written again."""

    triples: DataFrame  # (chunk_id, s, p, o)
    entities: DataFrame  # (id, name, vec): those with a vector
    synonyms: DataFrame  # (src, dst, w)
    parts: DataFrame  # (src, dst, kind, w) of facts and passages, to be added up over the batches

    def mentions(self) -> DataFrame:
        return mentions(self.triples)

    def nodes(self) -> DataFrame:
        m = self.mentions()
        return m.select(F.col("entity").alias("id"), F.lit("entity").alias("kind")).union(m.select("chunk_id", F.lit("passage"))).distinct()

    def edges(self) -> DataFrame:
        """(src, dst, w, kind)."""
        return with_synonyms(self.parts.groupBy("src", "dst", "kind").agg(F.sum("w").alias("w")), self.synonyms)


def extend(old: Graph | None, triples: DataFrame, vectors: DataFrame, least: float = SYNONYM_LEAST, most: int = SYNONYM_MOST) -> Graph:
    """The graph with a batch of triples(chunk_id, s, p, o) and of vectors(name, vec) of entities.

    Chunks that the graph has are left out. Only the batch's new entities are searched:
    they look for synonyms among all, and the others among them alone; of an old entity
    whose neighbours change, the best `most` are cut again. Batch after batch gives what
    one batch of all gives.
    """
    fresh = triples.select("chunk_id", "s", "p", "o")
    if old is not None:
        fresh = fresh.join(old.triples.select("chunk_id").distinct(), "chunk_id", "left_anti")
    fresh = stores.kept(fresh, "triples")
    m = mentions(fresh)
    named = m.select(F.col("entity").alias("name")).distinct().join(vectors.select("name", "vec").dropDuplicates(["name"]), "name").select(F.col("name").alias("id"), "name", "vec")
    if old is not None:
        named = named.join(old.entities.select("id"), "id", "left_anti")
    named = stores.kept(named, "entities")
    parts = stores.kept(weighted(fresh, m), "edges")
    if old is None:
        return Graph(fresh, named, stores.kept(synonym_edges(named, least, most), "synonyms"), parts)
    every = old.entities.union(named)
    found = neighbours(named, every, least, most).union(neighbours(old.entities, named, least, most))
    found = stores.kept(found.select("src", "dst", "w"), "new-synonyms")
    touched = found.select("src").distinct()
    again = old.synonyms.join(touched, "src", "left_semi").union(found)
    cut = stores.kept(ranking.top_k(again, most, "w", "dst", "src").select("src", "dst", "w"), "synonyms")
    return Graph(old.triples.union(fresh), every, stores.kept(old.synonyms.join(touched, "src", "left_anti").union(cut), "synonyms"), old.parts.union(parts))


def phrase_scores(facts: DataFrame, mentions_: DataFrame) -> DataFrame:
    """(qid, node, w): mean over the facts that name an entity of the fact's score over the entity's number of chunks. facts(qid, s, o, score)."""
    spread = mentions_.groupBy("entity").agg(F.count("*").alias("chunks"))
    named = facts.select("qid", "score", F.explode(F.array("s", "o")).alias("entity")).join(spread, "entity")
    return named.groupBy("qid", F.col("entity").alias("node")).agg(F.avg(F.col("score") / F.col("chunks")).alias("w"))


def top_phrases(weights: DataFrame, k: int) -> DataFrame:
    """The k best phrases of a query keep their weight, the others get 0."""
    d = ranking.ranked(weights, "w", "node")
    return d.select("qid", "node", F.when(F.col("rank") <= k, F.col("w")).otherwise(0.0).alias("w"))


def merged_reset(parts: list[tuple[DataFrame, float]], in_query: DataFrame, mentions_: DataFrame) -> DataFrame:
    """1 for query entities plus weighted scores of each part, over the entity's number of chunks. Parts and in_query: (qid, node, w)."""
    whole = in_query.select("qid", "node", F.lit(1.0).alias("w"))
    for part, weight in parts:
        whole = whole.union(part.select("qid", "node", (F.col("w") * weight).alias("w")))
    spread = mentions_.groupBy(F.col("entity").alias("node")).agg(F.count("*").alias("chunks"))
    return whole.groupBy("qid", "node").agg(F.sum("w").alias("w")).join(spread, "node").select("qid", "node", (F.col("w") / F.col("chunks")).alias("w"))


def expansion_score(pairs: DataFrame) -> DataFrame:
    """(qid, node, w): similarities summed per entity over the query's largest sum. pairs(qid, node, sim)."""
    from pyspark.sql import Window

    d = pairs.groupBy("qid", "node").agg(F.sum("sim").alias("s"))
    top = F.max("s").over(Window.partitionBy("qid"))
    return d.select("qid", "node", F.when(top > 0, F.col("s") / top).otherwise(0.0).alias("w"))


def survivors(mentions_: DataFrame, deleted: DataFrame) -> DataFrame:
    """(entity, chunks_left) when chunks go; an entity that no remaining chunk names has 0 and goes too."""
    gone = deleted.select("chunk_id").distinct().withColumn("gone", F.lit(True))
    return mentions_.join(gone, "chunk_id", "left").groupBy("entity").agg(F.count_if(F.col("gone").isNull()).alias("chunks_left"))


def delete(triples: DataFrame, edges: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """What is left of a graph when chunks go: triples, facts(s, p, o), entities(entity), nodes(id, kind) and edges.

    A fact or entity stays while a remaining chunk states or names it; an edge goes
    with either end. edges(src, dst, w, kind) as build() gives them: a passage's edges are
    its mentions, so those of remaining chunks stay and only the entities' are joined.
    """
    left = stores.kept(triples.join(deleted.select("chunk_id").distinct(), "chunk_id", "left_anti"), "triples-left")
    entities = stores.kept(left.select(F.explode(F.array("s", "o")).alias("entity")).distinct(), "entities-left")
    nodes = entities.select(F.col("entity").alias("id"), F.lit("entity").alias("kind")).union(left.select("chunk_id").distinct().select("chunk_id", F.lit("passage")))
    between = valid_edges(edges.where("kind = 'entity'"), entities.select(F.col("entity").alias("id")))
    named = mentions(left).where("chunk_id <> entity").select("chunk_id", "entity", F.lit(1.0))
    return {"triples": left, "facts": left.select("s", "p", "o").distinct(), "entities": entities, "nodes": nodes, "edges": between.union(named)}
