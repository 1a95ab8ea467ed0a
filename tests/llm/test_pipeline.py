"""The pipeline: stages keep the documents' columns and clean documents, and their decisions take effect."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."
    rows = [(i, text(120), "en", "src", 0) for i in range(80)]
    for i in range(0, 60, 2):
        rows[i] = (i, rows[i][1] + " vile rotten scumbag " + text(10), "en", "src", 0)
    rows += [(100, rows[1][1], "en", "src", 0), (101, rows[1][1].replace("w1", "w2", 1), "en", "src", 0), (102, None, None, None, None)]
    item = "which of these benchmark questions would a careful reader find inside a document"
    rows += [(103, text(60) + " " + item + " " + text(60), "en", "src", 0), (104, text(60) + " password=abcdef0123456789 " + text(60), "en", "src", 0)]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("score", "found", "class_id", "base")})
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/stage{k}")
        at = spark.read.parquet(f"{d}/stage{k}")
        ids.append({r["doc_id"] for r in at.select("doc_id").collect()})
    toxic = {i for i in range(0, 60, 2)}
    assert len(ids[0] & toxic) <= 2 and {1, 61, 102} <= ids[0]
    assert 1 in ids[1] and not {100, 101} & ids[1]
    assert ids[1] - ids[2] == {103}
    assert ids[3] == ids[2] == ids[4]
    redacted = spark.read.parquet(f"{d}/stage3").where("doc_id = 104").first()
    assert "<secret>" in redacted["text"] and "abcdef0123456789" not in redacted["text"]
