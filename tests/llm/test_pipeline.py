import os
import random

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from rillwave.llm.common import shared_dir
from rillwave.llm.mixing import mix


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names


def test_stages_match_what_they_promise(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(80))
        rows.append((10 * i, text, "en", "s", len(text)))
        if i % 3 == 0:
            rows.append((10 * i + 1, text.replace(" ", "  "), "en", "s", len(text)))
        if i % 4 == 0:
            near = text.split()
            near[40] = "changed"
            rows.append((10 * i + 2, " ".join(near), "en", "s", len(text)))
    rows += [(9001, "short", "en", "s", 5), (9002, None, None, None, None), (9003, " ".join(["spam"] * 100), "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("__kept_id2", F.lit(1)).withColumn("n_copies", F.lit(5))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append((name, before, docs))
        if name != "bpe":
            assert docs.columns == before.columns
    ids = {name: {r["doc_id"] for r in after.collect()} for name, _, after in seen}
    assert ids["quality rules"] == {r[0] for r in rows if r[0] < 9000}
    assert {i % 10 for i in ids["exact dedup"]} == {0, 1, 2} and not any(10 * (i // 10) in ids["exact dedup"] for i in ids["exact dedup"] if i % 10 == 1)
    assert {i // 10 for i in ids["near dedup"]} == set(range(60)) and len(ids["near dedup"]) == 60
    mixed = sorted(r["doc_id"] for r in seen[3][2].collect())
    assert mixed == sorted(r["doc_id"] for r in mix(seen[3][1]).collect()) == sorted(r["doc_id"] for r in seen[4][2].collect())
    assert {r["n_copies"] for r in seen[3][2].collect()} == {5}
    before = set(os.listdir(shared_dir(spark)))
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert [n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before] == ["pipeline"]
    assert sorted(r["doc_id"] for r in whole.collect()) == mixed


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
