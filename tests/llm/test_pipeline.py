"""The pipeline's stages, each against what its operator decides."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import exact_dedup, near_dedup, quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_goes_by_the_classifier(spark, sf_dir, stages):
    scores = quality.quality_scores(stages["documents"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stages["quality"]) == ids(scores.where("predicted = 1"))


def test_copies_go(stages):
    assert ids(stages["exact"]) == ids(exact_dedup.exact_dedup(stages["quality"]).where("kept"))
    assert ids(stages["near"]) == ids(near_dedup.near_dedup(stages["exact"], 5, 80).where("kept"))


def test_mixing_loses_no_document(stages):
    assert sorted(set(ids(stages["mix"]))) == ids(stages["near"])
    most = stages["mix"].groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert most <= 2


def test_last_stage_adds_what_it_measures(stages):
    row = stages["pieces"].first()
    assert row["n_span_bytes"] == len((row["text"] or "").encode()) and row["n_tokens"] > 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "The committee met on Tuesday and agreed that the bridge should be repaired before winter comes, as the old beams are weak. "


def after(spark, sf_dir, rows, *names, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        if name in names:
            docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
    return sorted(map(tuple, docs.collect()), key=str)


def row(i, text, source="a"):
    return (i, text, "en", source, len(text or ""))


def test_exact_stage_keeps_one_row_of_each_text(spark, sf_dir):
    a, b = "first text", "another text"
    got = after(spark, sf_dir, [row(3, a), row(5, a), row(5, b), row(5, b), row(5, b + " "), row(None, a), row(None, "no id"), row(None, "no id"), row(7, None), row(8, "")], "exact")
    assert Counter(r[1].strip() if r[1] else "" for r in got) == {a: 1, b: 1, "no id": 1, "": 1}
    assert row(3, a) in got and (5, b + " ", "en", "a", len(b) + 1) in got


def test_near_stage_keeps_rows_of_one_id_with_different_texts(spark, sf_dir):
    one, two = ([f"{w}{i}" for i in range(60)] for w in "ab")
    near = lambda words, k: " ".join([*words[:30], f"x{k}", *words[31:]])
    got = after(spark, sf_dir, [row(3, " ".join(one)), row(5, near(one, 1)), row(5, " ".join(two)), row(7, near(two, 2)), row(None, near(one, 3)), row(None, "quite another text without an id")], "near")
    assert [r[0] for r in got if r[1].startswith("a0")] == [3]
    assert len([r for r in got if r[1].startswith("b0")]) == 1
    assert row(None, "quite another text without an id") in got


def test_mix_stage_keeps_every_row(spark, sf_dir):
    rows = [row(i, GOOD * 3, "big") for i in range(40)] + [row(50, GOOD, "small"), row(50, "other words here", "small"), row(None, "a row without id", None), row(60, "", "none")]
    got = after(spark, sf_dir, rows, "mix")
    assert set(got) == set(rows)


def test_stages_take_clashing_columns(spark, sf_dir):
    extra = "row long, many string, turn int, times int, copy string, kept string, n_tokens long, pieces string, _copies int"
    rows = [(i, f"{GOOD} {i} " * 4, "en", "a", 9, i, "m", 1, 2, "c", "k", 3, "p", 4) for i in range(6)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "pieces":
            assert out.columns == docs.columns
            assert {tuple(r) for r in out.collect()} <= set(rows)
    assert all(r["n_tokens"] > 50 and r["kept"] == "k" for r in out.collect())


def test_stages_take_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        assert name == "pieces" or out.columns == docs.columns


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [row(1, ""), row(None, "text without id", None), row(2, None, "b"), row(3, "x " * 5000, "b"), row(3, "x " * 5000, "b"), row(3, "y " * 5000, "b")]
    names = [n for n, _ in corpus_pipeline.STAGES[1:4]]
    got = after(spark, sf_dir, rows, *names)
    assert {r[1] for r in got if r[1]} == {"text without id", "x " * 5000, "y " * 5000}
    assert len({(r[0], r[1]) for r in got}) == 4
    docs = spark.createDataFrame(got, SCHEMA)
    assert Counter(r["n_tokens"] > 0 for r in corpus_pipeline.stage_pieces(spark, docs, sf_dir).collect()) == Counter(bool(r[1]) for r in got)
