import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridcast.llm import substrings


def brute(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out.append((k, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.randint(0, 150)
            parts += [s[cut:] if rng.random() < 0.5 else s[: len(s) - cut], text(rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[4][1][:-1] + "#"), (102, "#" + rows[5][1]), (103, shared[0]), (104, shared[0][:199])]
    rows += [(110, "ab" * 300), (111, "a" * 500), (112, "a" * 200), (113, shared[1] + "|" + shared[1]), (114, text(9) + "q" * 201)]
    rows += [(120, None), (121, ""), (122, "short"), (None, shared[2] + "tail"), (None, "alone " + text(80)), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("length, spread, part, clash", [(200, 128, 8, False), (200, 128, 1, True), (200, 100, 3, False), (64, 32, 64, False), (200, 128, 50, True)])
def test_matches_brute_force(make_docs, length, spread, part, clash):
    rows = corpus(length + part)
    got = substrings.remove_repeats(make_docs(rows, clash), length=length, spread=spread, part=part)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, length)


def test_given_documents(given):
    docs = given("documents").limit(10**9)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, substrings.remove_repeats(docs).collect()), key=str) == brute(rows, 200)


def test_cells_cover_every_start_and_depend_on_content_alone(monkeypatch):
    rng = np.random.default_rng(2)
    data = bytes(rng.integers(97, 101, 3000, dtype=np.uint8))
    first, last, place = substrings.cells(data, 200, 128)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 127)).all()
    at = {p: int(q) for f, l, q in zip(first, last, place) for p in range(f, l + 1)}
    again = substrings.cells(b"xyz" + data[500:900] + b"zyx", 200, 128)
    for f, l, q in zip(*again):
        for p in range(max(f, 3), min(l, 203) + 1):
            assert at[p + 497] - (p + 497) == q - p
    monkeypatch.setattr(substrings, "SPAN", 300)
    f2, l2, p2 = substrings.cells(data, 200, 128)
    assert {p: int(q) for f, l, q in zip(f2, l2, p2) for p in range(f, l + 1)} == at


def test_limits(make_docs):
    assert substrings.remove_repeats(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(make_docs([]), length=30, spread=20)
