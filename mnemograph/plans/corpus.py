"""Queries over texts, stores and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.functions import decay, text, vec
from mnemograph.operators import enrich, texts
from mnemograph.plans.fixtures import table
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


def saved(df, tag, kind="parquet"):
    """df through a file of the given kind in the shared folder."""
    path = stores.shared_path(df.sparkSession, tag)
    getattr(df.write, kind)(path)
    return path


@query("SELECT 'chunk-' || md5(text) AS hash_id, text AS content, e.label FROM (SELECT text, min(doc_id) AS i FROM documents WHERE text IS NOT NULL GROUP BY text) d JOIN embeddings e ON e.vec_id = d.i % (SELECT count(*) FROM embeddings)")
def src1_embedding_store(spark, sf_dir):
    """Chunk store written and read with its schema; text ids join the vectors."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy("text").agg(F.min("doc_id").alias("i"))
    e = table(spark, sf_dir, "embeddings")
    d = docs.join(e, F.col("i") % max(e.count(), 1) == F.col("vec_id"))
    rows = d.select(text.hash_id(F.col("text"), "chunk-").alias("hash_id"), F.col("text").alias("content"), "embedding", "label")
    back = spark.read.schema(T.StructType([*stores.STORE.fields, T.StructField("label", T.IntegerType())])).parquet(saved(rows, "store"))
    return back.select("hash_id", "content", "label")


@query("SELECT DISTINCT 'conv-' || md5(text) AS hash_id, text AS content FROM conversations WHERE text IS NOT NULL")
def src2_conversation_store(spark, sf_dir):
    d = stores.hashed(table(spark, sf_dir, "conversations"), "text", "conv-")
    return spark.read.schema(stores.CONVERSATIONS).parquet(saved(d, "conversations"))


@query("SELECT user_id, 'p-' || event_id AS particle, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def src3_particle_conversations(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("particle"))
    return stores.members(m, "user_id", "particle")


@query("SELECT 'c-' || doc_id AS id, text FROM documents WHERE trim(text) <> ''")
def src4_jsonl_scan(spark, sf_dir):
    """Documents written as JSON lines under alternating field names, read back as (id, text)."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("c-"), F.col("doc_id").cast("string"))
    odd = F.col("doc_id") % 2 == 1
    lines = d.select(F.to_json(F.struct(F.when(odd, name).alias("id"), F.when(~odd, name).alias("chunk_id"), F.when(odd, F.col("text")).alias("content"), F.when(~odd, F.col("text")).alias("text"))).alias("value"))
    return stores.read_jsonl(spark, saved(lines, "lines", "text"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def src5_json_array(spark, sf_dir):
    """Conversations as files of one JSON array each, read with a schema."""
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    path = stores.shared_path(spark, "arrays")
    stores.write_json_arrays(d, path)
    return stores.read_json_array(spark, path, d.schema)


EXTRACT = """WITH d AS (SELECT o_orderkey, 'chunk-' || md5('order ' || o_orderkey) AS idx, o_orderstatus, o_orderpriority FROM orders)"""


def extractions(spark, sf_dir):
    """Extraction results as nested records: an entity list and triples per order."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    return o.select(F.col("o_orderkey"), text.hash_id(name, "chunk-").alias("idx"), name.alias("passage"), F.array(name, F.col("o_orderpriority")).alias("extracted_entities"), F.array(F.array(name, F.lit("has status"), F.col("o_orderstatus"))).alias("extracted_triples"))


@query(EXTRACT + " SELECT o_orderkey, idx FROM d WHERE o_orderstatus <> 'F'")
def src6_missing_extractions(spark, sf_dir):
    d = extractions(spark, sf_dir)
    done = d.where(F.col("extracted_triples")[0][2] == "F")
    back = spark.read.schema(done.schema).json(saved(done, "extractions", "json"))
    return stores.not_extracted(d.select("o_orderkey", "idx"), back)


@query("SELECT count(*) AS docs, round(avg(length(e)), 4) AS avg_ent_chars, round(avg(len(string_split(e, ' '))), 4) AS avg_ent_words FROM (SELECT unnest(['order ' || o_orderkey, o_orderpriority]) AS e FROM orders)")
def src7_extraction_stats(spark, sf_dir):
    d = stores.extraction_stats(extractions(spark, sf_dir))
    return d.select(F.col("entities").alias("docs"), F.round("avg_ent_chars", 4).alias("avg_ent_chars"), F.round("avg_ent_words", 4).alias("avg_ent_words"))


@query()
def src8_text_with_fallback(spark, sf_dir):
    """Pages stored as bytes, a third each as UTF-8, GBK and Latin-1 where these can hold them, decoded page by page whatever their charset."""
    from collections.abc import Iterator

    import pyarrow as pa

    def encoded(page_id: int | None, value: str) -> bytes:
        try:
            return value.encode(("utf-8", "gbk", "latin-1")[(page_id or 0) % 3])
        except UnicodeEncodeError:
            return value.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = (batch.column(c).to_pylist() for c in ("page_id", "value"))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(map(encoded, ids, values), pa.binary())], ["page_id", "content"])

    p = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", F.regexp_replace("html", r"\s+", " ")).alias("value"))
    pages = p.mapInArrow(run, f"page_id {p.schema['page_id'].dataType.simpleString()}, content binary")
    back = spark.read.schema(pages.schema).parquet(saved(pages, "pages"))
    return stores.decoded_rows(back, "page_id").select("page_id", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("hash"))


@query("SELECT o_orderkey AS question, count(DISTINCT l_partkey) AS parts, min(l_partkey) AS first_part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def src9_multi_hop_gold(spark, sf_dir):
    """Nested context (title, sentences) per question, exploded into a corpus and gold rows by title."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), F.struct(F.col("l_partkey").alias("title"), F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("sentences")).alias("c"), F.struct(F.col("l_partkey").alias("title"), F.lit(0).alias("i")).alias("f"))
    nested = lines.groupBy("question").agg(F.collect_list("c").alias("context"), F.collect_set("f").alias("facts"))
    _, found = texts.gold_by_title(nested)
    return found.groupBy("question").agg(F.countDistinct("title").alias("parts"), F.min("title").alias("first_part"))


@query("SELECT 'run ' || user_id AS file, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS epoch, 'Train Loss' AS metric, round(value, 2) AS number FROM events UNION ALL SELECT 'run ' || user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT), 'Val Loss', round(value + 1, 2) FROM events")
def src10_run_log(spark, sf_dir):
    """Each user's events as a log file's lines: an epoch line, then two metric lines."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w).alias("n"))
    rows = F.array(F.format_string("Epoch %d/999", "n"), F.concat(F.lit("  Train Loss: "), F.round("value", 2).cast("string")), F.concat(F.lit("  Val Loss: "), F.round(F.col("value") + 1, 2).cast("string")))
    lines = e.select(F.format_string("run %d", "user_id").alias("file"), "n", F.posexplode(rows).alias("p", "value")).select("file", (F.col("n") * 3 + F.col("p")).alias("n"), "value")
    return stores.run_log(lines)


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL) SELECT label, count(*) AS n, round(avg(v[1] / sqrt(list_inner_product(v, v))), 6) AS mean_first FROM e GROUP BY label""")
def src11_vector_scan(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("label", vec.unit(F.col("embedding"))[0].alias("x"))
    return d.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean_first"))


@query("WITH b AS (SELECT user_id AS id, event_id AS version, value FROM events) SELECT id, version, value FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1")
def src12_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), "value")
    return stores.upsert(e.where("version % 2 = 0"), e.where("version % 2 = 1"), "id", "version")


@query("SELECT event_id, value FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def src13_delete(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("event_type"))
    return stores.delete(e.select("event_id", "value", "event_type"), least, "event_type").select("event_id", "value")


@query("SELECT event_id, event_type, value FROM events WHERE event_id IN (SELECT c_custkey FROM customer) AND value > 100")
def src13_point_get(spark, sf_dir):
    """Events by the ids of customers and a bound on the value."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("event_id"))
    return stores.get(e, keys, F.col("value") > 100, "event_id")


@query("SELECT conv_id, turn, role = 'user' AS hit, md5(coalesce(text, '')) AS hash, length(coalesce(text, '')) AS chars FROM conversations")
def src15_result_sink(spark, sf_dir):
    """Nested records of each turn through the sink and back."""
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(t.alias("context"), F.array(F.length(t)).alias("scores"), (F.col("role") == "user").alias("hit")).alias("arm"))
    path = stores.shared_path(spark, "records")
    stores.write_records(d, path)
    back = spark.read.schema(d.schema).json(path)
    return back.select("conv_id", "turn", F.coalesce("arm.hit", F.lit(False)).alias("hit"), F.md5(F.col("arm.context").cast("binary")).alias("hash"), F.col("arm.scores")[0].alias("chars"))


@query("SELECT event_id, event_type, round(value, 2) AS value FROM events")
def src14_metadata_json(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", stores.metadata_json(F.struct("event_type", F.round("value", 2).alias("value"))).alias("m"))
    return e.select("event_id", F.from_json("m", "event_type string, value double").alias("x")).select("event_id", "x.*")


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Chapter ' || doc_id WHEN doc_id % 3 = 1 THEN coalesce(text, '') || chr(10) || 'see chapter 2' ELSE 'Chapter ' || doc_id || ' ' || replace(coalesce(text, ''), chr(10), ' ') || chr(10) || 'x' || chr(10) || 'y' END AS t FROM documents) SELECT doc_id, (length(trim(t)) < 50 AND regexp_matches(t, '(?i)\\bchapter\\s+[0-9]+')) OR (len(string_split(trim(t), chr(10))) <= 2 AND regexp_matches(t, '(?i)\\bchapter[ \\t]+[0-9]+')) AS title FROM t")
def flt6_chapter_title(spark, sf_dir):
    """Headings alone, a line after the text, and long first lines of three."""
    n, t = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Chapter "), n)).when(F.col("doc_id") % 3 == 1, F.concat(t, F.lit("\nsee chapter 2"))).otherwise(F.concat(F.lit("Chapter "), n, F.lit(" "), F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\nx\ny")))
    return table(spark, sf_dir, "documents").select("doc_id", text.chapter_title(made).alias("title"))


@query("WITH d AS (SELECT doc_id, regexp_replace(text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(t) AS hash, CASE WHEN length(t) + 21 >= 50 THEN md5(t) END AS after_heading FROM d WHERE length(t) >= 10 AND NOT regexp_matches(t, '(?i)\\bchapter\\s+[0-9]+')")
def flt7_text_cleaning(spark, sf_dir):
    """All texts, as they are and after a heading: both are the text without outer white space, or a title if it is short."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(text.CHAPTER))
    d = d.select("doc_id", text.cleaned(F.concat(F.lit("Chapter 1\nchapter 22\n"), F.regexp_replace("text", r"^[ \t\n\r\f\x0B]+", ""))).alias("a"), text.cleaned(F.col("text")).alias("b"))
    return d.where("b IS NOT NULL").select("doc_id", F.md5(F.col("b").cast("binary")).alias("hash"), F.md5(F.col("a").cast("binary")).alias("after_heading"))


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS hash FROM conversations WHERE text <> '' AND NOT (text LIKE '%Error%' OR text LIKE '%error%' OR text LIKE '%Timeout%' OR text LIKE '%HTTPSConnectionPool%' OR text LIKE '%ConnectionError%' OR text LIKE '%出错%')")
def flt8_valid_answer(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where(text.valid_answer(F.col("text")))
    return d.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("hash"))


MASS = "least(greatest(0.7 * (value / 500) + 0.3 * least(ln(value + 1) / ln(1001.0), 1.0), 0), 1)"


def masses(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", decay.chunk_mass(F.col("value") / 500, decay.surprisal(F.col("value"))).alias("mass"))


@query(f"SELECT event_type, count(*) AS n, count(*) FILTER ({MASS} > 0.8) AS high FROM events GROUP BY 1")
def flt9_high_mass(spark, sf_dir):
    return masses(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("mass") > 0.8).alias("high"))


@query(f"SELECT event_id, round({MASS}, 6) AS mass FROM events ORDER BY {MASS} DESC, event_id LIMIT 50")
def tk3_top_chunks_by_mass(spark, sf_dir):
    return masses(spark, sf_dir).orderBy(F.desc("mass"), "event_id").limit(50).select("event_id", r6("mass").alias("mass"))


@query("WITH i AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE text IS NOT NULL), s AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE text IS NOT NULL AND role = 'user') SELECT h AS hash_id FROM i WHERE h NOT IN (SELECT h FROM s)")
def jn1_insert_if_absent(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return stores.absent(stores.hashed(c, "text", ""), stores.hashed(c.where("role = 'user'"), "text", "")).select("hash_id")


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def jn2_id_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return stores.lookup(o, table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_name", "c_nationkey")


@query()
def jn9_interval_overlap(spark, sf_dir):
    """The words of each text by place, joined to the capitalised spans that they overlap."""
    d = table(spark, sf_dir, "documents")
    return texts.overlaps(texts.tokens(d), texts.entity_spans(d)).select("doc_id", "token_no", "tok_start", "tok_end", "char_start")


@query("WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id AS lid, min(doc_id) OVER (PARTITION BY t) AS rid FROM t")
def jn10_fuzzy_text_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return texts.fuzzy_match(d.select(F.col("doc_id").alias("lid"), "text"), d.select(F.col("doc_id").alias("rid"), "text"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, trim(substr(t, 1 + length(t) // 25, length(t) - length(t) // 25 - length(t) // 30)) AS t FROM t),
r AS (SELECT t, min(doc_id) AS rid FROM t GROUP BY t), e AS (SELECT l.doc_id, r.rid FROM l JOIN r USING (t)),
c AS (SELECT l.doc_id, min(r.rid) AS rid FROM l JOIN r ON abs(length(l.t) - length(r.t)) < 0.1 * greatest(length(l.t), length(r.t)) AND (contains(r.t, l.t) OR contains(l.t, r.t)) WHERE l.doc_id NOT IN (SELECT doc_id FROM e) GROUP BY 1)
SELECT doc_id AS lid, rid FROM e UNION ALL SELECT doc_id, rid FROM c""")
def jn10_contained_text_join(spark, sf_dir):
    """Texts without their first and last few hundredths find the whole ones."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.squeezed(F.col("text")).alias("t"))
    inner = F.expr("substring(t, 1 + length(t) div 25, length(t) - length(t) div 25 - length(t) div 30)")
    return texts.fuzzy_match(d.select(F.col("doc_id").alias("lid"), inner.alias("text")), d.select(F.col("doc_id").alias("rid"), F.col("t").alias("text")))


@query("WITH f AS (SELECT c_custkey AS i, c_name AS f, c_nationkey AS k FROM customer), c AS (SELECT n_nationkey AS k, unnest([n_name, 'Customer', n_name || ' customer']) AS c FROM nation) SELECT i AS fact_id, arg_min(c, (levenshtein(f, c), c)) AS match FROM f JOIN c USING (k) GROUP BY i")
def jn11_closest_string(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact_id"), F.col("c_name").alias("fact"), "c_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(F.col("n_name"), F.lit("Customer"), F.concat("n_name", F.lit(" customer")))).alias("candidate"))
    return texts.closest_strings(f.select("fact_id", "fact"), f.select("fact_id", "c_nationkey").join(F.broadcast(n), "c_nationkey").select("fact_id", "candidate"))


@query()
def jn13_negative_sampling(spark, sf_dir):
    """Five other vectors for each vector, drawn by hash."""
    e = table(spark, sf_dir, "embeddings")
    return texts.seeded_others(e.select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("gold")), e.select(F.col("vec_id").alias("id")), 5)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fixed' ELSE event_type END AS event_type FROM events")
def jn14_result_patching(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return stores.patched(e, e.where("event_id % 3 = 0").select("event_id", F.lit("fixed").alias("event_type")), "event_id", "event_type").select("event_id", "event_type")


FIRST_LINES = """WITH p AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS f FROM documents WHERE text IS NOT NULL), m AS (SELECT *, min(doc_id) OVER (PARTITION BY f) AS s FROM p),
x AS (SELECT f, doc_id, CASE WHEN doc_id = s THEN 'Wikipedia Title: ' || text ELSE chr(10) || trim(substr(text, length(f) + 1), chr(10)) END AS part FROM m)"""


@query(FIRST_LINES + " SELECT f AS first_line, CAST(0 AS BIGINT) AS piece, CAST(sum(length(part)) AS BIGINT) AS chars, md5(string_agg(part, '' ORDER BY doc_id)) AS hash FROM x GROUP BY f")
def ag24_merge_by_first_line(spark, sf_dir):
    """One text of all passages that share a first line."""
    m = texts.merged_by_first_line(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), "text"))
    return m.select("first_line", "piece", F.length("merged").cast("long").alias("chars"), F.md5(F.col("merged").cast("binary")).alias("hash"))


@query(FIRST_LINES + " SELECT f AS first_line, doc_id AS place, length(part) AS chars, md5(part) AS hash FROM x")
def ag24_first_line_parts(spark, sf_dir):
    """The parts of merged texts as rows."""
    m = texts.first_line_parts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), "text"))
    return m.select("first_line", "place", F.length("part").alias("chars"), F.md5(F.col("part").cast("binary")).alias("hash"))


def samples(spark, sf_dir):
    """Span datasets: one target at the start of each text, some of them wrong on purpose."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 12")
    label = F.expr("transform(sequence(0, 27), i -> CASE WHEN i = doc_id % 28 THEN 0.6 WHEN i = (doc_id + 1) % 28 THEN 0.8 ELSE 0.0 END)")
    strength = F.when(F.col("doc_id") % 7 == 0, 0.5).otherwise(1.0)
    end = F.when(F.col("doc_id") % 5 == 0, 1_000_000).otherwise(10)
    target = F.struct(F.substring("text", 1, 10).alias("span_text"), F.lit(0).alias("char_start"), end.alias("char_end"), label.alias("soft_label"), strength.alias("intensity"))
    return d.select(F.col("doc_id").alias("id"), "text", F.array(target).alias("targets"))


@query("""WITH d AS (SELECT doc_id AS i, length(text) = 10 AS short FROM documents WHERE length(text) >= 12), c AS (SELECT i, i % 5 <> 0 AS b, i % 7 <> 0 AS n FROM d)
SELECT count(*) AS targets, count(DISTINCT i) AS samples, count(*) FILTER (b) AS bounds_ok, count(*) FILTER (b) AS span_ok, count(*) AS dims_ok, count(*) AS range_ok, count(*) FILTER (n) AS intensity_ok,
round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END) * 2 + 2 + avg(CASE WHEN n THEN 1.0 ELSE 0.0 END), 6) AS score FROM c""")
def ag25_dataset_validation(spark, sf_dir):
    return texts.quality_score(texts.dataset_checks(samples(spark, sf_dir)))


@query("WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n FROM embeddings, range(1, 65) t(i) GROUP BY ALL) SELECT label, any_value(n) AS n, round(sqrt(sum(m * m)), 6) AS norm FROM x GROUP BY label")
def ag26_mean_pooling(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("label", vec.doubles(F.col("embedding")).alias("vec"))
    return texts.mean_pooled(d, ["label"]).select("label", "n", r6(vec.norm(F.col("mean"))).alias("norm"))


@query("WITH t AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents), k AS (SELECT CAST(floor(count(*) * 0.3 / 0.7) AS BIGINT) AS k FROM documents), q AS (SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn, text) AS n FROM conversations WHERE text <> '') SELECT 'doc' AS source, md5(coalesce(text, '')) AS hash FROM t UNION ALL SELECT 'qa', md5(text) FROM q, k WHERE q.n <= k.k")
def so4_proportional_mix(spark, sf_dir):
    """All documents and as many turns as make three tenths of the whole."""
    own = lambda source, name, *more: table(spark, sf_dir, name).select(F.lit(source).alias("source"), F.coalesce("text", F.lit("")).alias("text"), *more)
    none = [F.lit(None).cast("long").alias(c) for c in ("conv_id", "turn")]
    turns = own("qa", "conversations", "conv_id", "turn").where("text <> ''")
    mixed = texts.proportional_mix(own("doc", "documents", *none), turns, 0.3, "conv_id", "turn", "text")
    return mixed.select("source", F.md5(F.col("text").cast("binary")).alias("hash"))


@query("SELECT doc_id, 'chunk-' || md5(text) AS id FROM documents WHERE text IS NOT NULL")
def tx1_hash_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.hash_id(F.col("text"), "chunk-").alias("id"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')) AS hash FROM documents WHERE text IS NOT NULL")
def tx2_text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.normalised(F.col("text")).cast("binary")).alias("hash"))


@query()
def tx3_answer_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.answer_normalised(F.col("text")).alias("answer"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS hash FROM documents WHERE text IS NOT NULL")
def tx4_entity_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.squeezed(F.col("text")).cast("binary")).alias("hash"))


@query("WITH n AS (SELECT doc_id, p, trim(regexp_replace(x[p], '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS e FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS p FROM (SELECT doc_id, string_split(text, ',') AS x FROM documents WHERE text IS NOT NULL))), f AS (SELECT doc_id, e, min(p) AS p FROM n WHERE e <> '' GROUP BY doc_id, e) SELECT doc_id, count(*) AS n, md5(string_agg(e, '|' ORDER BY p)) AS hash FROM f GROUP BY doc_id")
def tx4_entity_list(spark, sf_dir):
    """What stands between a text's commas as names: squeezed, the first of equal ones kept."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.entities_normalised(F.split("text", ",")).alias("e")).where(F.size("e") > 0)
    return d.select("doc_id", F.size("e").cast("long").alias("n"), F.md5(F.array_join("e", "|").cast("binary")).alias("hash"))


@query()
def tx5_rule_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.rule_entities(F.col("text")).alias("entities"))


@query()
def tx6_pattern_entities(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.pattern_entities(F.col("text")).alias("entities"))


@query()
def tx7_entity_spans(spark, sf_dir):
    return texts.entity_spans(table(spark, sf_dir, "documents"))


def emotions(spark, sf_dir):
    """Texts that name emotions: two lexicon words each, by id, before the conversation's own words."""
    words = [w for w, _ in text.emotion_words()]
    lit = F.array(*map(F.lit, words))
    d = table(spark, sf_dir, "events").select("event_id", F.concat_ws(", ", lit[(F.col("event_id") % len(words)).cast("int")], lit[(F.col("event_id") * 7 % len(words)).cast("int")], F.col("event_type")).alias("text"))
    return d


LEX = "VALUES " + ", ".join(f"({n}, '{w}', '{c}')" for n, (w, c) in enumerate(text.emotion_words()))
N_LEX = len(text.emotion_words())


@query(f"WITH l(n, w, c) AS ({LEX}), e AS (SELECT event_id, a.c AS a, b.c AS b FROM events JOIN l a ON a.n = event_id % {N_LEX} JOIN l b ON b.n = event_id * 7 % {N_LEX}) SELECT event_id, CASE WHEN a = 'joy' AND b = 'joy' THEN 1.0 WHEN a = 'joy' OR b = 'joy' THEN 0.5 ELSE 0.0 END AS joy, CASE WHEN a = 'neutral' AND b = 'neutral' THEN 0.0 WHEN a = b THEN 1.0 ELSE 0.5 END AS intensity FROM e")
def tx8_lexicon_emotions(spark, sf_dir):
    d = emotions(spark, sf_dir).withColumn("s", text.emotion_shares(F.col("text")))
    return d.select("event_id", F.col("s")["joy"].alias("joy"), text.intensity(F.col("s")).alias("intensity"))


SHARES = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿœæß0-9_]+')) AS w FROM documents WHERE text IS NOT NULL), l AS (SELECT * FROM (" + "VALUES " + ", ".join(f"('{w}', '{c}')" for w, c in text.emotion_words()) + ") l(w, c)), n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (c = 'joy') AS joy, count(*) FILTER (c = 'anger') AS anger, count(*) FILTER (c = 'neutral') AS neutral FROM w JOIN l USING (w) GROUP BY doc_id)"


@query(SHARES + " SELECT d.doc_id, CASE WHEN trim(d.text) = '' THEN 0 WHEN n.n IS NULL THEN 1 ELSE round(neutral / n.n, 6) END AS neutral, coalesce(round(joy / n.n, 6), 0) AS joy, coalesce(round(anger / n.n, 6), 0) AS anger FROM documents d LEFT JOIN n USING (doc_id) WHERE d.text IS NOT NULL")
def ud2_emotion_extractor(spark, sf_dir):
    """The lexicon's shares over whole texts, by the extractor's default."""
    d = enrich.emotions(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"))
    at = text.CATEGORIES.index
    return d.select("doc_id", *(r6(F.col("emotions")[at(c)]).alias(c) for c in ("neutral", "joy", "anger")))


@query()
def tx9_chunker(spark, sf_dir):
    return texts.chunks(table(spark, sf_dir, "documents"), separator="\n")


def responses(spark, sf_dir):
    """Model answers as JSON inside prose, every seventh cut short."""
    e = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(F.round(F.col("value") / 500, 5).alias("joy"), F.round(1 - F.col("value") / 500, 5).alias("fear")))
    full = F.concat(F.lit("Scores: "), body, F.lit(" done"))
    return e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.regexp_replace(full, r"\} done", "")).otherwise(full).alias("response"))


@query("WITH x AS (SELECT event_id, round(value / 500, 5) AS j, round(1 - value / 500, 5) AS f FROM events) SELECT event_id, round(j / sqrt(j * j + f * f), 6) AS joy, round(f / sqrt(j * j + f * f), 6) AS fear FROM x")
def tx10_emotion_response(spark, sf_dir):
    d = responses(spark, sf_dir).withColumn("v", text.emotion_vector(F.col("response")))
    at = text.EMOTIONS.index
    return d.select("event_id", r6(F.col("v")[at("joy")]).alias("joy"), r6(F.col("v")[at("fear")]).alias("fear"))


@query("SELECT o_orderkey, 'order ' || o_orderkey AS s, 'has status' AS p, o_orderstatus AS o FROM orders")
def tx11_triple_response(spark, sf_dir):
    """Answers with the triple twice and a part of one; every fifth is cut short inside a last triple."""
    d = extractions(spark, sf_dir)
    odd = F.array(F.lit("order"), F.lit("alone"))
    full = F.to_json(F.struct(F.concat("extracted_triples", "extracted_triples", F.array(odd)).alias("triples")))
    short = F.concat(F.regexp_replace(F.to_json(F.struct(F.col("extracted_triples").alias("triples"))), r"\]\}$", ""), F.lit(', ["order", "is c'))
    answer = F.concat(F.lit("Here: "), F.when(F.col("o_orderkey") % 5 == 0, short).otherwise(F.concat(full, F.lit(" done"))))
    d = d.select("o_orderkey", F.explode(text.triples(answer)).alias("t"))
    return d.select("o_orderkey", F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


@query("SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['order ' || o_orderkey] ELSE ['order ' || o_orderkey, o_orderpriority] END) AS entity FROM orders")
def tx11_entity_response(spark, sf_dir):
    """Entity answers; every fifth is cut short inside the second name."""
    d = extractions(spark, sf_dir)
    full = F.to_json(F.struct(F.concat("extracted_entities", "extracted_entities").alias("named_entities")))
    short = F.concat(F.lit('{"named_entities": ["'), "passage", F.lit('", "2-H'))
    return d.select("o_orderkey", F.explode(text.named_entities(F.when(F.col("o_orderkey") % 5 == 0, short).otherwise(full))).alias("entity"))


@query("SELECT c_custkey, c_name AS entity, CASE c_custkey % 3 WHEN 0 THEN 'nation ' || c_nationkey WHEN 1 THEN 'calm and ' || c_nationkey ELSE 'People, name, ' || c_name || ', warm, glad' END AS description FROM customer")
def tx12_entity_descriptions(spark, sf_dir):
    """Lines `entity: description` and `entity - description`, and lines that only name the entity."""
    n = F.col("c_nationkey").cast("string")
    first = F.concat(F.lit("- "), "c_name", F.lit(": 1. nation "), n, F.lit(" ;\nother - none"))
    second = F.concat(F.lit("intro\n"), "c_name", F.lit(" - 2) calm and "), n, F.lit("."))
    third = F.concat(F.lit("nothing\nPeople name "), F.lower("c_name"), F.lit(", warm and glad"))
    kind = F.col("c_custkey") % 3
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("entity"), F.when(kind == 0, first).when(kind == 1, second).otherwise(F.replace(third, F.lower("c_name"), F.col("c_name"))).alias("response"))
    return texts.described(c.select("id", "response"), c.select("id", "entity")).select(F.col("id").alias("c_custkey"), "entity", "description")


@query("SELECT event_id, event_type AS answer FROM events")
def tx13_answer_after_marker(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat(F.lit("Thought: x\nAnswer:  "), F.col("event_type"), F.lit(" ")))
    return e.select("event_id", text.answer_after_marker(said).alias("answer"))


@query("WITH t AS (SELECT conv_id, turn, role, md5(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(coalesce(text, ''))) AS n FROM conversations QUALIFY n <= 5) SELECT conv_id, string_agg(h, '|' ORDER BY n) || '|Question: ' || conv_id AS prompt FROM t GROUP BY conv_id")
def tx14_prompt_assembly(spark, sf_dir):
    h = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    w = Window.partitionBy("conv_id").orderBy("turn", "h")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", h.alias("h")).withColumn("rank", F.row_number().over(w))
    return texts.prompts(c.select(F.col("conv_id").alias("qid"), F.col("conv_id").cast("string").alias("question"), "rank", F.col("h").alias("text"))).select(F.col("qid").alias("conv_id"), "prompt")


@query("""WITH n AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0), b AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE text IS NOT NULL)
SELECT 'graph' AS store, (SELECT count(*) FROM (SELECT h FROM n UNION SELECT h FROM a)) AS stored, (SELECT count(*) FROM n WHERE h NOT IN (SELECT h FROM a)) AS added
UNION ALL SELECT 'emotion', (SELECT count(*) FROM (SELECT h FROM n UNION SELECT h FROM b)), (SELECT count(*) FROM n WHERE h NOT IN (SELECT h FROM b))""")
def rt15_dual_ingest(spark, sf_dir):
    """All documents into a store that has a third of them and into one of conversations."""
    d = table(spark, sf_dir, "documents")
    old = {"graph": stores.hashed(d.where("doc_id % 3 = 0"), "text", "chunk-"), "emotion": stores.hashed(table(spark, sf_dir, "conversations"), "text", "chunk-")}
    return stores.ingest(d, old)[1]


def span_model(spans):
    """Soft labels of distinct label keys: the emotion shares of the span and what is around it, from the default extractor."""
    near = F.concat_ws(" ", "span_text", F.expr("substring(text, char_start + 1, 200)"))
    return enrich.emotions(spans.withColumn("near", near), "near", "soft_label").select("label_key", "soft_label")


@query()
def rt16_span_label_dataset(spark, sf_dir):
    """Clean texts with up to ten labelled spans each: labels by the hash of span and context, worked out where no earlier batch has them."""
    spans = stores.kept(texts.keyed_spans(table(spark, sf_dir, "documents")), "spans")
    nothing = spark.createDataFrame([], "label_key string, soft_label array<double>")
    earlier = enrich.completed(spans.where("doc_id % 2 = 0"), nothing, span_model, "label_key")[1]
    _, new = enrich.completed(spans, earlier, span_model, "label_key")
    return texts.labelled_samples(spans, earlier.union(new))


@query(f"SELECT e.event_id, e.event_type, v.label, round({MASS}, 6) AS mass FROM events e JOIN embeddings v ON v.vec_id = e.event_id % (SELECT count(*) FROM embeddings)")
def rt17_chunk_features(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    m = masses(spark, sf_dir).withColumn("vec_id", F.col("event_id") % max(v.count(), 1))
    return m.join(v, "vec_id").select("event_id", "event_type", "label", r6("mass").alias("mass"))


@query()
def rt17_features_of_chunks(spark, sf_dir):
    """Chunks of whole texts with the encoder's vector, the emotion score, a perplexity given with each chunk, and the mass of both."""
    c = texts.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored = c.withColumn("emotion_score", text.intensity(text.emotion_shares(F.col("text")))).withColumn("perplexity", (1 + F.length("text") % 1000).cast("double"))
    d = enrich.encoded(scored, "text", "vector").withColumn("surprisal_score", decay.surprisal(F.col("perplexity")))
    return d.select("doc_id", "chunk_no", "start_idx", "end_idx", "vector", "emotion_score", "surprisal_score", decay.chunk_mass(F.col("emotion_score"), F.col("surprisal_score")).alias("mass"))


@query()
def ud1_vector_encoder(spark, sf_dir):
    """The default encoder over whole documents, with a passage instruction."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return enrich.encoded(d, instruction="passage: ").select("doc_id", "vector")


@query(f"WITH l(n, w, c) AS ({LEX}), e AS (SELECT event_id, a.c AS a, b.c AS b FROM events JOIN l a ON a.n = event_id % {N_LEX} JOIN l b ON b.n = event_id * 7 % {N_LEX}), s AS (SELECT event_id, CASE WHEN a = b THEN 1.0 ELSE sqrt(0.5) END AS i, CASE WHEN a = b THEN 1.0 ELSE 0.5 END AS p FROM e) SELECT event_id, round(i, 6) AS intensity, round(p, 6) AS purity, round(1 + 50 * i, 6) AS weight FROM s")
def ud4_particle_build(spark, sf_dir):
    """Texts to emotion shares to particle properties in one plan."""
    d = emotions(spark, sf_dir).withColumn("v", F.map_values(text.emotion_shares(F.col("text"))))
    d = d.select("event_id", vec.norm(F.col("v")).alias("i"), vec.purity(F.col("v")).alias("p"))
    return d.select("event_id", r6("i").alias("intensity"), r6("p").alias("purity"), r6(decay.modulus(F.col("i"))).alias("weight"))


@query()
def ud4_particles_of_texts(spark, sf_dir):
    """Whole documents to entities, their sentences, emotion vectors and particle properties."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return enrich.particles(d)


@query("WITH e AS (SELECT md5(event_type || CAST(user_id AS VARCHAR)) AS k, event_id FROM events), done AS (SELECT DISTINCT k FROM e WHERE event_id % 2 = 0), t AS (SELECT event_id, k FROM e WHERE event_id % 2 = 1) SELECT event_id, md5('model ' || k) AS result, k IN (SELECT k FROM done) AS hit FROM t")
def ud5_cached_enrichment(spark, sf_dir):
    """Odd events ask by type and user; the even ones' answers are known. Others are worked out once a key."""
    e = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat("event_type", F.col("user_id").cast("string")).cast("binary")).alias("key"))
    answer = lambda d: d.select("key", F.md5(F.concat(F.lit("model "), "key").cast("binary")).alias("result"))
    known = stores.kept(answer(e.where("event_id % 2 = 0").select("key").distinct()), "answers")
    rows, new = enrich.completed(e.where("event_id % 2 = 1"), known, answer)
    return rows.join(new.select("key", F.lit(False).alias("known")), "key", "left").select("event_id", "result", F.coalesce("known", F.lit(True)).alias("hit"))


@query("WITH e AS (SELECT md5(event_type || CAST(user_id AS VARCHAR)) AS k, event_id FROM events), done AS (SELECT DISTINCT k FROM e WHERE event_id % 2 = 0), t AS (SELECT k FROM e WHERE event_id % 2 = 1) SELECT count(*) FILTER (k IN (SELECT k FROM done)) AS hits, count(*) FILTER (k NOT IN (SELECT k FROM done)) AS misses FROM t")
def ud5_cache_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.md5(F.concat("event_type", F.col("user_id").cast("string")).cast("binary")).alias("key"), "event_id")
    done, asked = e.where("event_id % 2 = 0").select("key").distinct(), e.where("event_id % 2 = 1").select("key")
    hits = enrich.missing(asked, done)[0].agg(F.count("*").alias("hits"))
    return hits.join(asked.agg(F.count("*").alias("n")), F.lit(True)).select("hits", (F.col("n") - F.col("hits")).alias("misses"))  # one row each
