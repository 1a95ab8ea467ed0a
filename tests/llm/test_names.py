"""Input columns named like an operator's own, or with a dot, stay as they are."""

import pytest
from pyspark.sql import functions as F

from labelframe.llm import decontamination, minhash, quality, secrets, toxicity, url_filters

OWN = ("_id", "_hash", "_node", "_key", "_tokens", "_rest", "_v", "_judged", "_row", "_o0", "row", "node", "key", "a.b", "window", "place")


@pytest.fixture(scope="module")
def named(spark):
    rows = [(1, "one two three four five six", "en", "http://x.com/en/1"), (2, None, None, None), (3, "AKIA" + "A1" * 12 + " w", "de", "http://y.net/de/")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, url string").withColumns({c: F.lit("own") for c in OWN})


def untouched(out):
    rows = out.collect()
    return len(rows) == 3 and all(r[c] == "own" for r in rows for c in OWN)


def test_names_stay(spark, named):
    items = spark.createDataFrame([(1, "which of these words would be found in no text at all"), (1, "which of these words would be found in no text at all")], "item_id long, text string")
    assert untouched(decontamination.remove_leaks(named, items))
    assert untouched(minhash.keep_one(named))
    assert untouched(secrets.scan(named, [0.0] * (len(secrets.ALPHABET) + 1) ** 2))
    assert untouched(url_filters.filter_urls(named))
    assert untouched(quality.judge_quality(named))
    assert untouched(toxicity.score(named, toxicity.train([], [])))


def test_empty_tables(spark, named):
    none = named.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_leaks(named, items).count() == 3 and decontamination.remove_leaks(none, items).count() == 0
    assert secrets.scan(none, secrets.train(secrets.labelled_samples(none))).count() == 0
    assert url_filters.filter_urls(none).count() == 0 and quality.judge_quality(none).count() == 0
