"""Decontamination, packing, near duplicates, repeats, WARC and language-model scores."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from labelframe.llm import anchors, decontamination, lm, minhash, packing, repeats, suffixes, warc
from labelframe.llm.common import shared_path
from labelframe.llm.graphs import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- decontamination


def test_re_parameterised_questions(spark):
    item = "Later Maria buys 12 apples, then Maria sells 12 pears, so Maria keeps 12 plums and Maria eats 12 figs each day on 3 km of road."
    other = "Later Karim buys 45 apples, then Karim sells 45 pears, so Karim keeps 45 plums and Karim eats 45 figs each day on 8 km of road."
    mixed = "Later Karim buys 45 apples, then Tom sells 46 pears, so Lena keeps 47 plums and Anna eats 48 figs each day on 8 km of road."
    unrelated = "The market was closed, and later nobody gives anything to her brother at all."
    docs = spark.createDataFrame([(1, f"Intro words here. {item} More."), (2, f"Some text. {other}"), (3, mixed), (4, unrelated), (5, None), (6, ""), (1, f"Intro words here. {item} More.")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "two words")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontamination.leaks(docs, items).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["same_values"] == 1 and rows[2]["same_values"] < 1 and rows[2]["consistency"] == 1
    assert sorted(r["doc_id"] for r in decontamination.remove_leaks(docs, items).collect()) == [3, 4, 5, 6]
    assert decontamination.leaks(docs, items.where("false")).count() == 0
    assert decontamination.leaks(docs.where("false"), items).count() == 0


def test_odd_rows_leak_nothing(odd, spark):
    items = spark.createDataFrame([(1, "some benchmark item that nobody has ever seen before")], "item_id long, text string")
    assert decontamination.leaks(odd, items).count() == 0
    assert decontamination.remove_leaks(odd, items).count() == 11


# ---- packing


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(1)
    bits = ["a", "Word", "'s", "I'LL", " ", "\n", "12", "½", "é", "É", "<|endoftext|>", "\x1c", "İ", "Σ", "ΟΔΟΣ", "K", "Å", "ﬁ", "中文", "😀", "...", "!?", " ", "é", "ß", "x²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, ""]
    for text, ids in zip(texts, packing.Encoder(TOKENIZER).encode(texts), strict=True):
        assert whole.encode(text or "", add_special_tokens=False).ids == ids.tolist(), text


def test_plan_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(20, 60)
        ends = np.array(sorted(rng.sample(range(1, n), 3)) + [n])
        at, penalty = packing.cut_points(ends, np.array(sorted(rng.sample(range(1, n), 5))), n, grid=2)
        cuts = packing.plan(at, penalty, 8)
        best = {0: 0.0}
        cost_at = dict(zip(at.tolist(), penalty.tolist(), strict=True))
        pad = lambda k: 0 if k in (4, 8) else 8 - k
        for j in at.tolist()[1:]:
            best[j] = min(best[i] + pad(j - i) for i in best if 0 < j - i <= 8) + cost_at[j]
        total = sum(pad(b - a) + cost_at[b] for a, b in zip([0, *cuts], cuts, strict=False))
        assert total == pytest.approx(best[n]) and cuts[-1] == n


def test_packing_is_a_partition(spark, odd, none, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = packing.pack(df, TOKENIZER).collect()
        texts = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r["doc_id"]].append(np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"))
        covered = collections.Counter()
        for r in rows:
            ids = texts[r["doc_id"]][0]
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            covered[r["doc_id"]] += r["length"]
        assert covered == {k: sum(map(len, v)) for k, v in texts.items()}
        sequences = collections.defaultdict(list)
        for r in rows:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        padding = total = 0
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert 0 < at <= 4096
            total += at
            padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert padding <= 0.03 * total
    assert packing.pack(none, TOKENIZER).count() == 0


# ---- near duplicates


def test_signatures_are_unbiased():
    rng = random.Random(1)
    errors = []
    for k in range(20):
        a = [f"w{rng.randrange(3000)}" for _ in range(300)] if k % 2 else [f"w{rng.randrange(3000)}" for _ in range(40)] * 8
        b = list(a)
        for _ in range(rng.randrange(1, 12)):
            b[rng.randrange(len(b))] = f"z{k}"
        x, y = minhash.shingles(" ".join(a)), minhash.shingles(" ".join(b))
        s = minhash.signatures([x, y], 1024)
        errors.append((s[0] == s[1]).mean() - minhash.similarity(x, y))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    assert np.isinf(minhash.signatures([minhash.shingles("")])).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101)] + [(200, 200 + i) for i in range(1, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 250)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = prose(rng, rng.randrange(60, 300)).split()
        for edits in (0, 0, 1, 2, 3, 5, 8, 13):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += ["", "", "a b", "A  b", "a b c", None, prose(rng, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [minhash.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or minhash.similarity(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    rows = minhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == {i: find(i) for i in range(len(texts))}
    kept = [r["doc_id"] for r in minhash.keep_one(df).collect()]
    assert sorted(kept) == sorted({find(i) for i in range(len(texts))})


def classes_by_brute_force(texts):
    bags = [minhash.shingles(t) for t in texts]
    lowest = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if lowest[i] != lowest[j] and minhash.similarity(bags[i], bags[j]) >= 0.8:
                one, other = sorted((lowest[i], lowest[j]))
                lowest = [one if x == other else x for x in lowest]
    return lowest


def test_large_group_against_brute_force(spark, monkeypatch):
    """Versions of one text, most of them too far apart; buckets are cut into blocks."""
    monkeypatch.setattr(minhash, "FEW", 16)
    monkeypatch.setattr(minhash, "MANY", 64)
    rng = random.Random(3)
    base = prose(rng, 200).split()
    texts = [" ".join(base)]
    for _ in range(250):
        words = list(base)
        for _ in range(rng.randrange(2, 12)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = classes_by_brute_force(texts)
    assert 5 < len(set(expected)) < 240
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == dict(enumerate(expected))


def test_corpus_classes_against_brute_force(spark, sf):
    """All pairs of the texts of a generated table; recall of near pairs and of classes is 1."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r["text"] for r in rows]
    lowest = classes_by_brute_force(texts)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    for i, t in enumerate(texts):  # copies without a shingle too
        if first[t] != i and lowest[first[t]] != lowest[i]:
            one, other = sorted((lowest[i], lowest[first[t]]))
            lowest = [one if x == other else x for x in lowest]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {r["doc_id"]: rows[lowest[i]]["doc_id"] for i, r in enumerate(rows)}


def test_odd_rows_stay(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r["class_id"]].add(r["doc_id"])
    assert classes[1] == {1, 2} and classes[3] == {3, 4}
    assert minhash.keep_one(odd).count() == 8 and minhash.keep_one(odd).columns == odd.columns
    clash = odd.withColumns({c: F.lit("own") for c in ("_node", "_key", "key", "row", "a.b")})
    once = minhash.keep_one(clash).collect()
    assert len(once) == 8 and all(r[c] == "own" for r in once for c in ("_node", "_key", "key", "row", "a.b"))
    assert minhash.near_duplicates(none).count() == 0


# ---- repeats


def slow_removal(texts):
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for raw in raws:
        mask = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                mask[i : i + 200] = b"\1" * 200
        spans = sum(1 for i, m in enumerate(mask) if m and not (i and mask[i - 1]))
        yield len(raw), sum(mask), spans, hashlib.sha256(bytes(x for x, m in zip(raw, mask, strict=True) if not m)).hexdigest()


def test_repeats_against_brute_force(spark, odd, none):
    rng = random.Random(7)
    passage = prose(rng, 90)
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "de" * 300]
    for k in range(30):
        cut = rng.randrange(0, 100), rng.randrange(150, len(passage))
        texts.append(prose(rng, rng.randrange(20, 80)) + passage[cut[0] : cut[1]] + prose(rng, rng.randrange(20, 80)))
    copy = prose(rng, 100)
    texts += [copy, copy, copy[:300] + "é" + copy[300:], copy[1:], "x" + copy, passage[:200], passage[5:205], passage[100:299]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}
    assert rows == dict(enumerate(slow_removal(texts)))
    assert repeats.remove_repeats(odd).count() == 11 and repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_short_line_and_passage_in_many_texts(spark, monkeypatch, most):
    """A line of 121 bytes that repeats nothing, and a passage with other surroundings everywhere; with groups in one task and not."""
    monkeypatch.setattr(repeats, "SORTED", most)
    rng = random.Random(11)
    line, passage = prose(rng, 40)[:121], prose(rng, 80)[:310]
    texts = [prose(rng, rng.randrange(5, 40)) + (line if k % 3 else passage) + prose(rng, rng.randrange(5, 40)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}
    assert rows == dict(enumerate(slow_removal(texts)))


def test_deep_shallow_sorting():
    rng = random.Random(5)
    some = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 220))) for _ in range(60)]
    some += [some[0][:100] + x for x in some[:20]] + [b"x" * 150 + x for x in some] + some[:10] + [b""]
    assert [some[i] for i in suffixes.deep_shallow(some)] == sorted(some)


def test_extents_against_brute_force():
    rng = random.Random(1)

    def slow(zones, length):
        for i, (body, at) in enumerate(zones):
            hits = []
            for s in range(min(at, len(body) - length) + 1):
                k = at - s
                if any(j != i and other >= k and text[other - k : other - k + length] == body[s : s + length] for j, (text, other) in enumerate(zones)):
                    hits.append(s)
            yield (hits[0], hits[-1]) if hits else None

    for _ in range(100):
        parts = [[bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2)] for _ in range(rng.randrange(2, 30))]
        zones = list({(a + b"GRAM" + b, len(a)) for a, b in parts if len(a + b) >= 8})
        assert suffixes.extents(zones, 12, 4) == list(slow(zones, 12))


def test_anchor_of_each_window():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 2**63, 500, dtype=np.uint64)
    got = anchors.anchors_of(grams, 37)
    assert got.tolist() == [i + int(np.argmin(grams[i : i + 37] >> np.uint64(24))) for i in range(len(grams) - 36)]


# ---- WARC


def test_shards_of_far_ids_nulls_and_long_payloads(spark):
    """One far id, many nulls and a long payload make no large shard; columns named like the writer's own stay out."""
    rows = [(i, f"http://a/{i}", "x" * 400 + str(i)) for i in range(2000)] + [(10**15, "http://far", "far"), (5, "http://long", "é" * 3_000_000)]
    rows += [(None, f"http://n/{i}", "y" * 400 + str(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("key", "digest", "first", "mark", "shard", "size", "a.b")})
    root = shared_path(spark, "warc-far")
    manifest = warc.write_warc(df, root, shard_bytes=100_000, roll_bytes=4_000).collect()
    records = collections.Counter()
    for r in manifest:
        records[r["shard"]] += r["records"]
    assert len(records) > 25 and max(records.values()) <= 170
    assert len(manifest) > len(records)  # files roll within a shard
    back = warc.read_warc(spark, root).collect()
    assert len(back) == 3002 and max(r["payload_bytes"] for r in back) == 6_000_000
    again = warc.write_warc(df.repartition(7), shared_path(spark, "warc-far"), shard_bytes=100_000, roll_bytes=4_000).collect()
    assert sorted((r["file"].split("/")[-1], r["sha256"]) for r in again) == sorted((r["file"].split("/")[-1], r["sha256"]) for r in manifest)


def test_warc_round_trip(spark):
    rows = [(i, f"http://x.example/{i}\r\nX: y", ("<p>same</p>" if i % 3 == 0 else f"<p>é {i}</p>" * (i % 7)) or None) for i in range(200)]
    rows += [(None, None, "<p>same</p>"), (5, "again", rows[5][2]), (10**12, "far", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    made = []
    for _ in range(2):
        root = shared_path(spark, "warc-test")
        manifest = warc.write_warc(df, root, shard_bytes=20_000, roll_bytes=4_000)
        made.append(sorted(tuple(r) for r in manifest.collect()))
    assert made[0] == made[1] and len(made[0]) > 3
    back = warc.read_warc(spark, root, with_payload=True).collect()
    assert len(back) == len(rows)
    firsts = {}
    for k, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        firsts.setdefault(h or "", k)
    by = collections.Counter((k, (h or "")) for k, _, h in rows)
    payloads = {hashlib.sha1(h.encode()).digest(): h for _, h in by}
    import base64

    got = collections.Counter()
    for r in back:
        h = payloads[base64.b32decode(r["payload_digest"])]
        got[r["page_id"], h] += 1
        assert r["payload_bytes"] == len(h.encode())
        first = firsts.get(h)
        if r["page_id"] is None or r["page_id"] == first:
            assert r["record_type"] == "response" and r["refers_to"] is None and bytes(r["payload"]).decode() == h
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == first
    assert got == by
    root = shared_path(spark, "warc-none")
    warc.write_warc(df.where("false"), root)
    assert warc.read_warc(spark, root).count() == 0


# ---- language-model scores


def test_base_scores_against_brute_force(spark, odd, none):
    for df in (odd, none):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        counts = collections.Counter()
        tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
        for i, w in tokens:
            if i is not None and zlib.crc32(str(i).encode()) % 10:
                counts.update(w)
        total, size = sum(counts.values()), len(counts)
        want = sorted((i is None, i or 0, len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (size + 1))) for x in w), 6)) for i, w in tokens)
        got = lm.score(df).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and r["train_tokens"] == total for r in got)


def test_probabilities_of_a_byte_sum_to_one():
    counts = np.zeros((lm.ORDERS, 2, lm.SLOTS))
    keys = lm.segments("the cat sat on the mat and the cat ran")
    lm.add_counts(counts, keys, np.ones(len(keys)))
    model = lm.fit(counts, [keys])
    bits = lm.bits_of(model, [b"\0" * lm.LEFT + bytes([c]) for c in range(256)])
    assert (0.5**bits).sum() == pytest.approx(1, abs=1e-4)
    assert lm.bits_of(model, lm.segments("the cat"))[:1].sum() < lm.bits_of(model, lm.segments("xqz jkw"))[:1].sum()
    whole = lm.Scorer(model).log10(["the cat", None, "the cat"])
    assert whole[0] == whole[2] and whole[1] < 0


def test_model_beats_uniform_bytes_on_unseen_texts(spark, sf):
    rows = lm.score(spark.read.parquet(f"{sf}/documents.parquet")).where("held_out").collect()
    assert rows and sum(r["bits_per_byte"] for r in rows) / len(rows) < 4
