"""Columns whose names operators use themselves, and rows that name no document."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import cgk_decontam, fair_mix, ordinal_quality, ppm_lang
from tidemark.llm._names import unused

NAMES = ["turn", "passes", "copies", "mix_key", "score", "lang_pred", "tails", "expected_grade", "ppm_body", "id", "key", "node", "label", "n", "size"]


@pytest.fixture(scope="module")
def clashing(odd_docs):
    base = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    return base.select("*", *[F.lit(100 + i).alias(n) for i, n in enumerate(NAMES)])


def test_unused_names():
    assert unused(["A", "b_"], "a", "b", "b") == ["a_", "b", "b__"]


def test_mixed_keeps_clashing_columns(clashing):
    out = fair_mix.mixed(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert rows and all(r[n] == 100 + i for r in rows for i, n in enumerate(NAMES))


def test_scores_replace_their_own_names_only(spark, clashing):
    out = ppm_lang.predict(clashing, ppm_lang.fit(clashing))
    assert {c for c in out.columns if out.columns.count(c) > 1} == set() and out.count() == clashing.count()
    assert {r.tails for r in out.select("tails").collect()} == {106}
    rated = spark.createDataFrame([(i, i % 3) for i in range(12)], "doc_id long, grade int")
    scored = ordinal_quality.score(clashing, ordinal_quality.fit(clashing, rated))
    assert scored.count() == clashing.count() and scored.filter("size(tails) <> 2").isEmpty()


def test_item_ids_of_any_type(spark):
    words = [f"word{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "other words here")], "doc_id short, text string")
    for kind in ("short", "int", "string"):
        items = spark.createDataFrame([(7, " ".join(words[3:20]))], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
        got = cgk_decontam.find(docs, items)
        assert [(r.doc_id, str(r.item_id), r.edits) for r in got.collect()] == [(1, "7", 0)] and dict(got.dtypes)["item_id"] == dict(items.dtypes)["item_id"]


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def test_stages_keep_clashing_columns_and_empty_tables(spark, pipeline, clashing, tmp_path):
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    clashing.write.parquet(f"{folder}/documents.parquet")
    for docs in (spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/documents.parquet").limit(0)):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            assert all(r[n] == 100 + i for r in out.collect() for i, n in enumerate(NAMES)), name
        assert pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_rows_without_an_id_never_link_documents(spark, pipeline, tmp_path):
    rng = random.Random(3)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    one, two = text(), text()
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, " ".join(one[:-1])), (None, " ".join(two[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tidemark.llm import ngram_join

    got = {r.doc_id: r.component_id for r in ngram_join.join(docs).filter("doc_id is not null").collect()}
    assert got == {1: 1, 2: 2}
    kept = pipeline.near_copies(spark, docs, str(tmp_path))
    assert {1, 2} <= {r.doc_id for r in kept.collect()}


def test_run_equals_its_stages(spark, pipeline, tmp_path):
    rng = random.Random(4)
    words = ["kato", "miru", "sone", "tako", "ripe", "lomu"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice("aeiou") for _ in range(40)), "xx", f"s{i % 2}", 0) for i in range(40)]
    rows += [(50, rows[3][1], "xx", "s0", 0), (51, None, None, None, None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < len(pipeline.STAGES) - 1:
            docs.write.parquet(f"{folder}/stage{i}")
            docs = spark.read.parquet(f"{folder}/stage{i}")
    assert sorted(docs.collect()) == sorted(pipeline.run(spark, folder).collect())
