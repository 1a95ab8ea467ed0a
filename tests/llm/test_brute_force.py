"""The classifier and the likelihood ratio against plain loops; the pipeline from end to end on odd and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelframe.llm import secrets, toxicity


def slow_score(m, text):
    rows = [sum(m.embedding[b] for b in toxicity.buckets(w)) for w in (text or "").lower().encode().split()] or [np.zeros(toxicity.DIM)]
    found = []
    for k, filters in enumerate(m.filters):
        for f in range(toxicity.FILTERS):
            sums = [sum(float(rows[i + o] @ filters[o][:, f]) for o in range(len(filters)) if i + o < len(rows)) for i in range(len(rows))]
            found.append(max(0.0, max(sums) + m.bias[k * toxicity.FILTERS + f]))
    z = sum(x * w for x, w in zip(found, m.out, strict=True)) + m.out_bias
    return 1 / (1 + math.exp(-(m.scale[0] * z + m.scale[1])))


def test_classifier_against_loops(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["vile", "fine", "good", "rot!", "(ten", "a"]) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    m = toxicity.train(texts, ["vile" in t for t in texts])
    texts += [None, "", "one", "vile " * 3000]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")), m).collect()
    for r in rows:
        assert r["score"] == pytest.approx(slow_score(m, texts[r["doc_id"]]), abs=1e-4)


def test_ratio_against_a_table(spark):
    samples = [("Zx9Qw8Er7Ty6Ui5O", 1), ("aB3dE6gH9jK2mN5p", 1), ("user_account_name", 0), ("config/default/path", 0)]
    weights = secrets.train(spark.createDataFrame(samples, "token string, label int"))
    n = len(secrets.ALPHABET)

    def slow(token):
        out = 0.0
        for a, b in zip("\0" + token, token, strict=False):
            i, j = secrets.ALPHABET.find(b) + 1, secrets.ALPHABET.find(a) + 1
            logs = []
            for label in (1, 0):
                pairs = [(x, y) for t, c in samples if c == label for x, y in zip("\0" + t, t, strict=False)]
                single = {c: sum(y == c for _, y in pairs) + 0.5 for c in secrets.ALPHABET}
                own = sum(x == a and y == b for x, y in pairs)
                logs.append(math.log((own + 5 * single[b] / sum(single.values())) / (sum(x == a for x, _ in pairs) + 5)))
            out += logs[0] - logs[1]
            assert weights[j * (n + 1) + i] == pytest.approx(logs[0] - logs[1])
        return out

    tokens = ["Zx9Qw8Er7Ty6Ui5O", "user_account_name", "q=/+-"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.log_ratio(F.col("t"), weights).alias("x")).collect()
    for r in got:
        assert r["x"] == pytest.approx(slow(r["t"]))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path, odd, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = str(tmp_path)
    docs = odd.where("false") if empty else odd
    docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, d).collect()
    if empty:
        assert rows == []
        return
    # Without labels nothing is toxic: copies and near copies go, and each other text is packed whole.
    assert len({r["doc_id"] for r in rows}) == 8 and {1, 3, None} <= {r["doc_id"] for r in rows}
    for doc in {r["doc_id"] for r in rows}:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
        assert sum(n for _, n, _ in own) == own[0][2] and own[0][0] == 0
