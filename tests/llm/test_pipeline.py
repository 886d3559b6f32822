import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from obliqua.llm import binary_output, queries

from .conftest import words

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def test_stages_in_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "pii", "best_fit_packing"]


@needs_tables
def test_stages_one_by_one_equal_the_run(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.98 * counts[0]
    whole = corpus_pipeline.run(spark, FOLDER)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_stages_with_odd_tables(spark, frame, odd_texts, tmp_path):
    for name, texts in (("empty", []), ("odd", odd_texts)):
        docs = frame(texts, langs=[None if i % 3 == 0 else "en" for i in range(len(texts))])
        docs = docs.withColumn("score", docs.doc_id).withColumn("component_id", docs.doc_id)
        for stage_name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, "")
            path = str(tmp_path / f"{name}-{stage_name}")
            made.write.parquet(path)
            if stage_name != "best_fit_packing":
                assert made.columns == docs.columns
                docs = spark.read.parquet(path)


def test_names_that_the_stages_use_themselves(spark, frame):
    texts = [words(k, 60) + f"\nthe same line in all of the texts\n{words(100 + k, 30)}" for k in range(6)]
    docs = frame(texts)
    for k, name in enumerate(("__lang_pred", "__lang_score", "__doc", "__row", "__dropped", "_ _x", "n_shingles", "item")):
        docs = docs.withColumn(name, F.lit(f"kept {k}"))
    plain = frame(texts)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made, want = stage(spark, docs, ""), stage(spark, plain, "")
        assert made.columns == docs.columns
        got = made.collect()
        assert all(r["__lang_pred"] == "kept 0" and r["__dropped"] == "kept 4" for r in got)
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((r["doc_id"], r["text"]) for r in want.collect())


def test_rows_with_one_id_or_none(spark, frame):
    same, other = words(1, 50), words(2, 50)
    docs = frame([same, same, other, other, same, same, None, None, words(3, 50)], [1, 1, 1, 1, None, None, None, None, 2])
    got = sorted((repr(r["doc_id"]), r["text"] or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted([("1", same), ("1", other), ("None", same), ("None", ""), ("2", words(3, 50))])


def test_nothing_is_left_behind_on_errors(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda session, name: str(tmp_path / name))
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: frame([words(1, 50)]))

    def fails(*_):
        raise KeyError("stage")

    stages = [("one", lambda s, docs, d: docs), ("two", lambda s, docs, d: docs), ("three", fails), ("four", fails)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    with pytest.raises(KeyError):
        corpus_pipeline.run(spark, "")
    assert list(tmp_path.iterdir()) == []
    monkeypatch.setattr(binary_output, "scratch_path", lambda session, name: str(tmp_path / name))
    monkeypatch.setattr(binary_output, "read_shards", fails)
    with pytest.raises(KeyError):
        binary_output.token_output(frame(["a b"]), queries.tokenizer_path("byte_bpe_50k.json"))
    assert list(tmp_path.iterdir()) == []


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_return_a_row_for_each_input(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    table = {"op5": "embeddings", "op11": "pages"}.get(name.split("_")[0], "documents")
    assert got.count() >= spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_tasks_of_the_jaccard_join_drop_encoders_that_a_worker_has_kept():
    from obliqua.llm import jaccard_join, tokens

    for task in (jaccard_join._frequent(5, 2, 100), jaccard_join._verify(5, 80), jaccard_join._apart(80, 256)):
        tokens._encoders["kept", 1] = None
        assert list(task(iter([]))) is not None and not tokens._encoders
