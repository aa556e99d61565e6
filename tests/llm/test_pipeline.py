"""Each stage of the corpus pipeline on a planted table."""

import random

import corpus_pipeline
import pytest

RND = random.Random(5)
SYLLABLES = {"en": "the ing er on an re and th tion ha".split(), "de": "sch der ung ein keit zu en ver ß ü".split()}


def prose(lang, n):
    return " ".join("".join(RND.choice(SYLLABLES[lang]) for _ in range(RND.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    item = prose("en", 40)
    rows = [(n, prose(lang, 120), lang) for n, lang in enumerate(["en", "de"] * 40)]
    rows += [(100, "12345 !!", "en"), (101, None, "en"), (102, prose("en", 20), "en")]  # no language; null; too short
    rows += [(103, rows[3][1], "de"), (104, rows[4][1] + " more", "en")]  # copies
    rows += [(105, prose("en", 100) + " " + item, "en")]  # contaminated
    d = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet")
    columns, gone = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, planted)
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        gone.append(before - after)
        assert out.columns[: len(columns)] == columns
        path = f"{planted}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert gone == [{100, 101}, {102}, {103, 104}, {105}, set()]
    assert {r["doc_id"] for r in docs.collect()} == set(range(80)) and "ids" in docs.columns
    assert corpus_pipeline.run(spark, planted).count() == 80


def test_empty(spark, planted, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{planted}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
