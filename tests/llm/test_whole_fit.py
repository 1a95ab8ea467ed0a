"""The toxicity classifier learns from all labelled rows and their whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelframe.llm import toxicity


def _labelled(spark, n, words):
    rng = random.Random(9)
    filler = [f"{a}{b}" * 9 for a in "abcdefgh" for b in ("lo", "mi", "nu", "ra")]
    rows = []
    for i in range(n):
        text = rng.choices(filler, k=words)
        if i % 3 == 0:
            text[rng.randrange(words)] = "vile"
        rows.append((i, " ".join(text), "en", int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic"), rows


def test_texts_of_any_length_are_learned_from(spark):
    documents, labels, rows = _labelled(spark, 120, 4200)
    assert min(len(r[1]) for r in rows) > 100_000
    model = toxicity.fit(documents, labels, toxicity.Settings(epochs=10))
    bad, good = toxicity.Scorer(model).scores(["alo vile anu", "alo bmi anu"])
    assert bad > 0.5 > good


def test_every_labelled_row_counts(spark, monkeypatch):
    """More rows of a class than were once drawn, in several shards: the counts are those of a loop, and each shard is met."""
    documents, labels, rows = _labelled(spark, 5000, 4)
    size = sum(len(r[1]) for r in rows)
    counted, of = [], toxicity._counted
    monkeypatch.setattr(toxicity, "_counted", lambda seen: counted.append((of(seen), seen.select("shard").distinct().count())) or counted[-1][0])
    model = toxicity.fit(documents, labels, toxicity.Settings(epochs=4, shard_bytes=size // 5))
    (met, n), shards = counted[0]
    h = F.xxhash64("doc_id")
    learned = {r[0] for r in documents.where(toxicity.eligible() & (F.pmod(F.shiftright(h, 7), F.lit(5)) != 0)).select("doc_id").collect()}
    texts = [[r[1] for r in rows if r[0] in learned and r[3] == c] for c in (0, 1)]
    assert n.tolist() == [len(x) for x in texts] and shards > 2
    for c in (0, 1):
        want = np.zeros(toxicity.BUCKETS)
        for t in texts[c]:
            want[list({b for w in t.encode().split() for b in toxicity.buckets(w)})] += 1
        assert np.array_equal(met[c], want)
    assert toxicity.Scorer(model).scores(["alo vile anu"])[0] > 0.5 > toxicity.Scorer(model).scores(["alo bmi anu"])[0]


def test_shards_of_one_are_the_fit_in_one_memory(spark):
    """One shard's epoch changes the model as descending in one memory does."""
    documents, labels, _ = _labelled(spark, 90, 6)
    rows = documents.join(labels, "doc_id").select(F.lit(0).cast("long").alias("shard"), "text", "toxic").coalesce(1)
    state = toxicity.State.of(toxicity.train([], []))
    local = toxicity.State.of(toxicity.train([], []))
    for x in (local.model.embedding, local.embedding_squares):
        x[...] = x.astype(np.float32)
    texts = rows.collect()
    s, known = toxicity.Settings(), toxicity.Memo(toxicity.buckets)
    order = np.random.default_rng([s.seed, 0, 0]).permutation(len(texts))
    toxicity._descend(local, lambda i: toxicity._ids(texts[i]["text"], known), np.array([r["toxic"] for r in texts]), np.ones(len(texts)), order, s.rate, s.batch)
    state = toxicity._epoch(rows, state, 0, s)
    assert state.model.embedding == pytest.approx(local.model.embedding, abs=1e-6)
    assert toxicity._dense(state.model) == pytest.approx(toxicity._dense(local.model), abs=1e-6)


def test_maxima_by_blocks(monkeypatch):
    """Blocks that cut texts find the same maxima at the same places."""
    rng = np.random.default_rng(1)
    known = toxicity.Memo(toxicity.buckets)
    texts = [toxicity._ids(" ".join(rng.choice(["a", "b", "cc", "dd e", "f"], n)), known) for n in (1, 40, 0, 3, 7, 100)]
    lengths = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    model = toxicity.train([], [])
    whole = toxicity._best(model, np.concatenate(texts), starts, lengths)
    for block in (1, 2, 7, 41):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        top, where = toxicity._best(model, np.concatenate(texts), starts, lengths)
        assert top == pytest.approx(whole[0]) and (where == whole[1]).mean() > 0.95


def test_thresholds_from_all_rows(spark):
    """The threshold of the best F1, against a loop over the scores."""
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None]), int(rng.random() < 0.3), rng.gauss(0, 1)) for _ in range(400)]
    rows = [(lang, toxic, z + 1.5 * toxic - 1) for lang, toxic, z in rows]
    df = spark.createDataFrame(rows, "lang string, toxic int, z double")
    sums = [F.count("*").alias("n"), F.sum("toxic").alias("pos"), F.sum("z").alias("total"), F.min("z").alias("low"), F.max("z").alias("high")]
    model = toxicity.train([], [])
    toxicity.calibrate(model, df.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.floor(F.col("z") * (1 << 20)).alias("bin")).agg(*sums))
    assert set(model.thresholds) == {"en", "de", ""}
    for lang, t in [(None, model.threshold), *model.thresholds.items()]:
        own = [(toxicity.sigmoid(model.scale[0] * z + model.scale[1]), y) for x, y, z in rows if lang is None or (x or "") == lang]

        def f1(cut, own=own):
            return 2 * sum(y for p, y in own if p >= cut) / (sum(p >= cut for p, _ in own) + sum(y for _, y in own))

        assert f1(t) == pytest.approx(max(f1(p) for p, _ in own))
