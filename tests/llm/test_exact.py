import hashlib

import pytest
from pyspark.sql import functions as F

from gridcast.llm import exact

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b" * 200_000), (6, "b" * 200_000), (7, "ü"), (None, "a"), (None, "z"), (8, "q"), (8, "q")]


def want(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        keep = best(known) if known else None
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep, best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("clash", [False, True])
def test_groups_match_brute_force(make_docs, keep, best, clash):
    got = exact.duplicate_groups(make_docs(ROWS, clash), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS, best)


def test_texts_that_share_a_hash_are_told_apart_by_their_bytes(make_docs):
    weak = lambda c: F.length(c).cast("string").cast("binary")
    got = exact.duplicate_groups(make_docs(ROWS), keep="largest", hashed=weak)
    assert sorted(map(tuple, got.collect()), key=str) == want(ROWS, max)


def test_empty_table(make_docs):
    assert exact.duplicate_groups(make_docs([])).count() == 0
    assert exact.drop_duplicates(make_docs([])).count() == 0


def test_drop_keeps_one_row_per_text_and_all_columns(make_docs):
    docs = make_docs(ROWS, clash=True)
    got = exact.drop_duplicates(docs, keep="largest")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect() if r["doc_id"] is not None) == sorted(
        [(2, "a"), (4, ""), (6, "b" * 200_000), (7, "ü"), (8, "q")]
    )
    assert [r["text"] for r in got.filter("doc_id is null").collect()] == ["z"]


def test_unknown_rule(make_docs):
    with pytest.raises(ValueError):
        exact.duplicate_groups(make_docs([]), keep="newest")


def test_plan_has_no_python(make_docs):
    plan = exact.duplicate_groups(make_docs(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
