import hashlib

import corpus_pipeline
import numpy as np
from test_simhash import brute
from tokenizers import Tokenizer

import __spark_entry__ as entry
from gridcast.llm import leaks, quality
from gridcast.llm.catalog import GOOD, QUERIES, WORD_BPE

ORDER = ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]


def expected(docs, labels, benchmark):
    """The stages on plain lists of (doc_id, text)."""
    net = quality.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [r for r in rows if quality.score(net, r[1] or "") >= GOOD]
    best = {}
    for k, t in rows:
        best[t or ""] = max(best.get(t or "", k), k)
    rows = [(k, t) for k, t in rows if best[t or ""] == k]
    stay = {c for _, _, c in brute(rows)}
    rows = [r for r in rows if r[0] in stay]
    index = leaks.build([(r["item_id"], r["text"]) for r in benchmark.collect()])
    rows = [r for r in rows if not leaks.leaks_in(index, r[1] or "")]
    library, out = Tokenizer.from_file(WORD_BPE), []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        out.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    return sorted(out)


def test_run_matches_brute_force(spark, sf_dir, given):
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == expected(given("documents"), given("labels"), given("benchmark"))
    assert 0 < len(got) < given("documents").count()


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf_dir, make_docs, tmp_path):
    text = "the old stone house stands by the river and its garden is full of roses in the summer"
    docs = make_docs([(1, text), (2, text), (2, text), (3, None), (4, ""), (None, text + " again"), (10**17 + 1, text.replace("old", "new") * 900)], clash=True)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        if n == 0:  # what a learned filter makes of these texts is its own affair
            out.count()
            continue
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
    assert 10**17 + 1 in {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()


def test_empty_documents(spark, sf_dir, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, sf_dir)
        assert docs_out.count() == 0


def test_entry_lists_every_query():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == [*range(1, 14)]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracle_of_exact_dedup(spark, sf_dir):
    from compare import differences, duck

    name = "op9_exact_dedup"
    assert differences(entry.queries()[name](spark, sf_dir), duck(sf_dir), entry.oracle_sql()[name]) == []
