import re
from collections import Counter

import pytest
import tiktoken  # noqa: F401

from gridcast.llm import rollup
from gridcast.llm.catalog import BYTE_BPE, op6_token_counts

CHANGE = "doc_id long, version string, action string, source string, lang string, n_tokens long, n_bytes long"


def totals(kept):
    return {tuple(r)[:3]: tuple(r)[3:] for r in kept.totals().collect()}


def apply(state, changes):
    """The same rules on a dictionary of live documents."""
    order = lambda c: (c[2] == "delete", c[3] or "", c[4] or "", c[5] or 0, c[6] or 0)
    best = {}
    for c in changes:
        if c[0] is not None and c[1] is not None and c[2] in ("insert", "revise", "delete"):
            k = (c[0], c[1])
            best[k] = c if k not in best or order(c) > order(best[k]) else best[k]
    for k, c in best.items():
        if c[2] == "delete":
            state.pop(k, None)
        else:
            state[k] = (c[3], c[4], c[5] or 0, c[6] or 0)
    out = {}
    for (_, v), (s, l, t, b) in state.items():
        n = out.get((s, l, v), (0, 0, 0))
        out[s, l, v] = (n[0] + 1, n[1] + t, n[2] + b)
    return out


def test_batches_follow_a_plain_ledger(spark, tmp_path):
    kept, state = rollup.Rollup(spark, str(tmp_path)), {}
    assert totals(kept) == {} and kept.batches() == []
    batches = [
        [(1, "v1", "insert", "a", "en", 10, 40), (2, "v1", "insert", "a", None, 5, 9), (3, "v1", "insert", None, None, 7, 8), (2, "v2", "insert", "a", None, 4, 9)],
        [(1, "v1", "revise", "b", "en", 11, 41), (2, "v1", "delete", None, None, None, None), (9, "v1", "delete", "a", "en", 1, 1), (4, "v1", "revise", "a", "en", 3, 3)],
        [(2, "v1", "insert", "a", None, 6, 9), (4, "v1", "insert", "a", "en", 3, 3), (4, "v1", "delete", "a", "en", 3, 3), (None, "v1", "insert", "a", "en", 9, 9), (5, None, "insert", "a", "en", 9, 9), (5, "v1", "upsert", "a", "en", 9, 9)],
        [],
        [(1, "v1", "insert", "b", "en", 11, 41), (1, "v1", "insert", "b", "en", 12, 41), (1, "v1", "insert", "b", "en", 12, 41), (6, "v1", "insert", "c", "de", None, None)],
    ]
    for n, batch in enumerate(batches):
        changes = spark.createDataFrame(batch, CHANGE)
        want = apply(state, batch)
        assert kept.commit(changes, f"b{n}")
        assert totals(kept) == want
        assert not kept.commit(changes, f"b{n}")  # again: nothing happens
        assert totals(rollup.Rollup(spark, str(tmp_path))) == want
    assert kept.batches() == [f"b{n}" for n in range(len(batches))]


def test_an_unfinished_batch_counts_nothing_and_can_be_sent_again(spark, tmp_path):
    kept = rollup.Rollup(spark, str(tmp_path))
    batch = [(1, "v1", "insert", "a", "en", 10, 40)]
    for kind, schema in (("entries", rollup.ENTRY), ("deltas", rollup.DELTA)):  # written, then the driver was lost
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{kind}/b0")
    assert totals(kept) == {}
    assert kept.commit(spark.createDataFrame(batch, CHANGE), "b0")
    assert totals(kept) == {("a", "en", "v1"): (1, 10, 40)}


def test_query_equals_counting_each_document(spark, sf_dir, given):
    encode = rollup.encoding(BYTE_BPE).encode_ordinary
    want = Counter()
    for r in given("documents").collect():
        t = r["text"] or ""
        for n, x in zip(rollup.AMOUNTS, (1, len(encode(t)), len(t.encode()))):
            want[r["source"], r["lang"], n] += x
    got = op6_token_counts(spark, sf_dir).collect()
    assert {(r["source"], r["lang"], n): r[n] for r in got for n in rollup.AMOUNTS} == dict(want)
    assert {r["version"] for r in got} == {"byte_bpe_50k"}


def test_odd_texts(make_docs):
    rows = [(10**17 + 1, None), (2, ""), (3, "a" * 20_000, "en", "s"), (None, "x"), (4, "<|endoftext|>"), (4, "<|endoftext|>")]
    got = rollup.token_counts(make_docs(rows, clash=True), BYTE_BPE, "v").collect()
    by = {r["doc_id"]: (r["n_tokens"], r["n_bytes"]) for r in got}
    assert len(got) == 6 and by[10**17 + 1] == by[2] == (0, 0) and by[3][1] == 20_000 and by[4][0] > 1
    assert rollup.token_counts(make_docs([]), BYTE_BPE, "v").count() == 0


@pytest.mark.parametrize("name", ["b0"])
def test_totals_without_documents_go(spark, tmp_path, name):
    kept = rollup.Rollup(spark, str(tmp_path))
    kept.commit(spark.createDataFrame([(1, "v1", "insert", "a", "en", 1, 1)], CHANGE), name)
    kept.commit(spark.createDataFrame([(1, "v1", "delete", None, None, None, None)], CHANGE), "b1")
    assert totals(kept) == {}


def test_bases_change_nothing_and_bound_what_a_batch_reads(spark, tmp_path):
    """Random changes with a base every three batches; a base that was not finished is not used."""
    import random

    rng = random.Random(7)
    kept, state = rollup.Rollup(spark, str(tmp_path), buckets=4, compact=3), {}
    for n in range(8):
        batch = [(rng.randrange(12), rng.choice(["v1", "v2"]), rng.choice(["insert", "revise", "delete"]), rng.choice("ab"), rng.choice(["en", None]), rng.randrange(9), 1) for _ in range(6)]
        want = apply(state, batch)
        assert kept.commit(spark.createDataFrame(batch, CHANGE), f"b{n}")
        assert totals(kept) == want
        if n == 4:  # as if the driver had been lost before the totals of a base were complete
            spark.createDataFrame([], rollup.ENTRY).write.parquet(f"{tmp_path}/bases/5/entries")
            assert totals(kept) == want and kept.base() == 3
    assert kept.base() == 6
    small = spark.createDataFrame([(3, "v1", "insert", "a", "en", 5, 5)], CHANGE)
    plan = kept.entries([2])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert kept.commit(small, "b8") and totals(kept) == apply(state, [(3, "v1", "insert", "a", "en", 5, 5)])
