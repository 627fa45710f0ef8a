"""Large integer keys beside a missing one come back as they were from every operator that reads texts."""

import pytest

from gridcast.llm import bpe, html, language, leaks, pages, quality, simhash, substrings, warc
from gridcast.llm.catalog import WORD_BPE

BIG = 10**17 + 1
TEXT = "the grey heron carried a long reed over the frozen river and nobody in the village saw it leave at dawn " * 3
KEYS = {None, BIG, 5}


@pytest.fixture(scope="module")
def docs(make_docs):
    return make_docs([(None, TEXT), (BIG, TEXT), (5, None)]).coalesce(1)


def test_operators_keep_keys(spark, docs):
    field = language.train([TEXT, "der graue reiher trug ein langes schilf " * 9], ["en", "de"], epochs=1)
    net = quality.train(["good text " * 30, "@@@@ ####"], [1, 0], epochs=1, steps=2)
    tables = [
        language.predict(docs, field),
        quality.scores(docs, net),
        simhash.near_duplicates(docs),
        substrings.remove_repeats(docs),
        bpe.digests(docs, WORD_BPE),
        bpe.encode(docs, WORD_BPE),
    ]
    for table in tables:
        rows = table.collect()
        assert {r["doc_id"] for r in rows} == KEYS and len(rows) == 3
    found = leaks.leaks(docs, spark.createDataFrame([(BIG, TEXT)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, BIG), (BIG, BIG)}
    web = docs.selectExpr("doc_id as page_id", "text as html", "'u' as url")
    assert {r["page_id"] for r in html.extract(web, html.train(pages.labelled_pages(20), epochs=2)).collect()} == KEYS
    assert {r["page_id"] for r in warc.archive_round_trip(web).collect()} == KEYS


def test_samples_bound_rows_not_ids(spark, make_docs, monkeypatch):
    """Rows that repeat one id do not break the bound of a sample."""
    docs = make_docs([(7, TEXT, "en", "s")] * 50 + [(8, "kurz", "de", "s")])
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, names, **_: seen.append(len(texts)))
    monkeypatch.setattr(quality, "train", lambda texts, marks, **_: seen.append(len(texts)))
    language.fit(docs, sample=10)
    quality.fit(docs, labels, sample=10)
    assert len(seen) == 2 and max(seen) <= 10
