"""Plug points for models, and particles built from texts.

An encoder or extractor is a function from a list of texts to one vector each; it is
called on whole batches in the tasks. Without one, the defaults are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemograph.functions import decay, text, vec
from mnemograph.sources import stores

Model = Callable[[list[str]], Sequence]

#: Dimensions of the default encoder; texts that a model gets at once.
DIMS, BATCH = 64, 256


def by_model(df: DataFrame, column: str, out: str, model: Model, batch: int, before: str = "", normalise: bool = False) -> DataFrame:
    """df with the model's vectors; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [before + (t or "") for t in rows.column(column).to_pylist()]
            found = [np.asarray(v, np.float64) for a in range(0, len(texts), batch) for v in model(texts[a : a + batch])]
            if normalise:
                found = [v / n if (n := np.linalg.norm(v)) > 0 else v for v in found]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(pa.float64()))], [*rows.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def encoded(df: DataFrame, column: str = "text", out: str = "vector", model: Model | None = None, instruction: str = "", normalise: bool = True, batch: int = BATCH) -> DataFrame:
    """df with a vector of each text, the instruction put before it. Default model: counts of hashed character trigrams."""
    if model:
        return by_model(df, column, out, model, batch, instruction, normalise)
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    t = F.lower(F.concat(F.lit(instruction), F.coalesce(column, F.lit(""))))
    # letters once a text, as a substring by place would go through the text again for each gram
    three = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    grams = text.bound(t, lambda x: F.when(F.length(x) >= 3, text.bound(F.split(x, ""), three)).otherwise(F.array(x)))
    coded = HashingTF(inputCol="grams_", outputCol="coded_", numFeatures=DIMS).transform(df.withColumn("grams_", grams))
    values = vector_to_array("coded_")
    return coded.select(*df.columns, (vec.unit(values) if normalise else values).alias(out))


def emotions(df: DataFrame, column: str = "text", out: str = "emotions", model: Model | None = None, batch: int = BATCH) -> DataFrame:
    """df with an emotion vector of each text. Default model: shares of the lexicon's categories."""
    if model:
        return by_model(df, column, out, model, batch)
    return df.withColumn(out, F.map_values(text.emotion_shares(F.col(column))))  # in the order of CATEGORIES


def properties(v: Column) -> dict[str, Column]:
    """What a particle has of its emotion vector."""
    strength, pure = vec.norm(v), vec.normalised_purity(v)
    return {
        "intensity": strength, "purity": vec.clipped_purity(v), "temperature": decay.linear_temperature(pure), "speed": decay.speed(strength, pure),
        "tau_v": decay.time_constant(pure, 1.0), "tau_t": decay.time_constant(pure, 2.0), "weight": decay.modulus(strength),
    }


def particles(texts: DataFrame, descriptions: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """(text_id, entity, entity_id, emotions, and the properties) of texts(text_id, text): one row per entity of a text.

    An entity's vector is of its description, from descriptions(text_id, entity,
    description); where there is none, of the sentences that name it.
    """
    naming = lambda sentences: F.transform(text.rule_entities(F.col("text")), lambda e: F.struct(e.alias("entity"), F.array_join(F.filter(sentences, lambda s: F.contains(s, e)), ". ").alias("own")))
    e = texts.where("text IS NOT NULL").select("text_id", F.inline(text.bound(F.split("text", r"[.!?]+"), naming)))  # no copy of the text a row
    if descriptions is None:
        e = e.withColumn("description", F.lit(None).cast("string"))
    else:
        e = e.join(descriptions.select("text_id", "entity", "description").dropDuplicates(["text_id", "entity"]), ["text_id", "entity"], "left")
    said = e.select("text_id", "entity", F.coalesce("description", "own").alias("said"))
    ids = text.hash_id(F.concat_ws("|", F.col("text_id").cast("string"), text.normalised(F.col("entity"))), "entity-")
    d = emotions(said, "said", "emotions", model).withColumn("entity_id", ids)
    return d.select("text_id", "entity", "entity_id", "emotions", *(c.alias(n) for n, c in properties(F.col("emotions")).items()))


def missing(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """asked split by a cache of earlier results: rows with their result, and distinct keys that are yet to be worked out."""
    return asked.join(cache, key), asked.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def completed(asked: DataFrame, cache: DataFrame, model: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows, new): asked(key, ...) with its result, and the results that the cache hadn't yet.

    model gives the result columns to a frame of distinct keys. It is asked for each
    missing key once: what it gives is written to the shared folder in one job, committed
    as a whole, and only read from there, so that neither a repeated task nor the two
    uses here call it again. cache.union(new) is the next cache.
    """
    found, todo = missing(asked, cache, key)
    new = stores.kept(model(todo).select(cache.columns), "enriched")
    return found.unionByName(asked.join(new, key)), new
