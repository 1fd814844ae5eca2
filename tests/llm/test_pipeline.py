"""Registered queries with SQL twins, and the pipeline stage by stage."""

import random

import pytest

import corpus_pipeline
from oracle_check import compare, connect
from storelens.llm.queries import ORACLE, QUERIES
from storelens.session import stored


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, folder, name):
    left, right, difference = compare(spark, connect(folder), QUERIES[name], ORACLE[name], folder)
    assert difference is None and left == right


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            new = docs.select("doc_id").distinct().join(before.select("doc_id"), "doc_id", "left_anti")
            assert new.count() == 0
        if name in ("secrets", "mixing"):  # nothing is dropped
            assert before.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert docs.count() > 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, folder, odd, nothing, name, stage):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    assert stage(spark, docs, folder).count() > 0
    assert stage(spark, docs.where("false"), folder).count() == 0


def test_secrets_are_masked(spark, folder):
    rows = [(1, "a token = abcdefgh12 b", "en", "s", 22), (2, "clean", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.mask_secrets(spark, docs, folder).collect()}
    assert got == {1: ("a [SECRET] b", 12), 2: ("clean", 5)}


def test_mixing_repeats_skewed_corpora_up_to_the_targets(spark, tmp_path):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(600):
        quality = k % 2  # half of the corpus, a tenth asked
        text = " ".join(rng.choice([f"q{quality}w{j}" for j in range(30)]) for _ in range(rng.randint(30, 60)))
        rows.append((k, text, "en", "s", len(text)))
        labels.append((k, quality, int(k % 10 == 9)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = "size(split(text, ' '))"
    mixed = corpus_pipeline.mix(spark, docs, str(tmp_path))
    got = mixed.selectExpr(f"sum(if(doc_id % 2 = 0, {words}, 0)) / sum({words}) as low", "count(distinct doc_id) as n").first()
    assert got.n == 600 and abs(got.low - corpus_pipeline.TARGETS["quality0"]) < 0.01


def test_near_duplicate_stage_deals_texts_out_once(spark):
    rows = [(k, f"text number {k} of its own words {k * k}", "en", "s", 30) for k in range(50)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sorted(map(tuple, kept.collect())) == sorted(set(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    texts = [k for k, line in enumerate(plan) if "SortAggregate" in line and "text" in line]
    assert len(texts) == 2 and not any("Exchange" in line for line in plan[texts[0] : texts[1]])
