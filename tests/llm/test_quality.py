import zlib

import numpy as np
import pytest

from gridcast.llm import quality
from gridcast.llm.catalog import op4_quality
from gridcast.llm.common import table

GOOD = "the old stone house stands by the river and its garden is full of roses in the summer"
BAD = "BUY!! NOW%%% CHEAP### CLICK$$$ HERE!! WIN&&& PRIZE*** "


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    good = [" ".join(rng.permutation(GOOD.split()).tolist()) * int(rng.integers(1, 20)) for _ in range(60)]
    bad = [" ".join(rng.permutation(BAD.split()).tolist()) * int(rng.integers(1, 20)) for _ in range(30)]
    return quality.train(good + bad, [1] * 60 + [0] * 30, epochs=8)


def brute_score(net, text):
    """Every place convolved by hand, chunks of 512 bytes every 256, padded with zeros."""
    data = text.encode()
    half = quality.HALF * quality.STRIDE
    n = max(2, -(-len(data) // half)) * half
    data += bytes(n - len(data) + quality.WIDTH)
    chunks = []
    for c in range(0, n - half, half):
        best = np.full(quality.FILTERS, -np.inf)
        for p in range(c, c + 2 * half, quality.STRIDE):
            best = np.maximum(best, sum(net.tables[j, data[p + j]].astype(float) for j in range(quality.WIDTH)))
        chunks.append(np.maximum(best + net.bias, 0))
    chunks = np.array(chunks)
    z = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)]) @ net.weights + net.offset
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("text", ["", "a", GOOD, BAD * 30, "é" * 700, "x" * 512, "x" * 513, GOOD * 40 + BAD])
def test_score_matches_plain_convolution(net, text, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 3)
    assert abs(quality.score(net, text) - brute_score(net, text)) < 1e-4


def test_the_end_of_a_long_text_counts(net):
    long = GOOD * 3000
    assert quality.score(net, long + BAD * 3000) < quality.score(net, long)


def test_odd_texts(make_docs, net):
    rows = [(1, None), (2, ""), (3, GOOD), (4, BAD), (4, BAD), (None, GOOD), (5, BAD * 5000)]
    got = [(r["doc_id"], r["score"]) for r in quality.scores(make_docs(rows, clash=True), net).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] and by[3] == by[None] > 0.5 > by[4] and by[5] < 0.5
    assert quality.scores(make_docs([]), net).count() == 0


def test_keep_good_keeps_rows_as_they_are(make_docs, net):
    docs = make_docs([(10**17 + 1, GOOD, None, "s"), (2, BAD), (None, GOOD), (3, None)], clash=True)
    kept = quality.keep_good(docs, net, 0.3)
    assert kept.schema == docs.schema
    want = [tuple(r) for r in docs.collect() if quality.score(net, r["text"] or "") >= 0.3]
    assert [tuple(r) for r in kept.collect()] == want and len(want) >= 2


def test_without_both_labels(make_docs, spark):
    labels = spark.createDataFrame([(1, 1), (3, None), (4, 7)], "doc_id long, quality int")
    only = quality.fit(make_docs([(1, GOOD)]), labels)
    assert quality.score(only, BAD) > 0.9
    none = quality.fit(make_docs([]), labels.limit(0))
    assert quality.score(none, BAD) == pytest.approx(0.5)


def test_held_out_accuracy(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest folder has a handful of rejected documents
    found = op4_quality(spark, larger).join(table(spark, larger, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in found)
    tested = [r for r in found if r["held_out"] and r["quality"] is not None]
    good = [r["score"] for r in tested if r["quality"] == 1]
    bad = [r["score"] for r in tested if r["quality"] == 0]
    assert good and bad
    assert np.mean([g > b for g in good for b in bad]) > 0.85
