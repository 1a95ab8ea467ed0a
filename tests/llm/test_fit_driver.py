"""What the fit sends to the driver and leaves there."""

import os

import numpy as np
from pyspark import SparkContext

from labelframe.llm import toxicity


def _labelled(spark, n=400):
    rows = [(i, f"word{i % 97} and more" + " vile" * (i % 3 == 0), "en", int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    return df.drop("toxic"), df.select("doc_id", "toxic")


def test_the_fit_leaves_no_broadcast(spark, monkeypatch):
    made, of = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(of(self, value)) or made[-1])
    toxicity.fit(*_labelled(spark), toxicity.Settings(epochs=2))
    assert len(made) == 3 and not any(os.path.exists(b._path) for b in made)


def test_an_epoch_sends_the_driver_little(spark, monkeypatch):
    """No more than the model's numbers take as they are sent out; a task without rows sends nothing."""
    more = [(0, " ".join(f"w{k}x{j}" for j in range(40)), k % 2) for k in range(4000)]
    rows = spark.createDataFrame(more, "shard long, text string, toxic int").coalesce(1)
    frame, sent, runs = type(rows), [], []
    collect, mapped = frame.collect, frame.mapInArrow

    def kept(self):
        out = collect(self)
        sent.append(sum(len(r["data"]) for r in out))
        return out

    monkeypatch.setattr(frame, "collect", kept)
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema: runs.append(run) or mapped(self, run, schema))
    state = toxicity.State.of(toxicity.train([], []))
    before = state.model.embedding.copy()
    state = toxicity._epoch(rows, state, 0, toxicity.Settings())
    assert (state.model.embedding != before).any(axis=1).sum() > 1000 and np.isfinite(state.model.embedding).all()
    numbers = 2 * toxicity.BUCKETS * toxicity.DIM
    assert len(sent) == 1 and sent[0] < 4.5 * numbers
    assert [list(run(iter([]))) for run in runs] == [[]]
