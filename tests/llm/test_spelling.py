import random
import re
import zlib
from collections import Counter

import pytest

from gridcast.llm import spelling
from gridcast.llm.catalog import op13_spelling


def brute(rows, least=6, times=5, every=199, factor=5):
    counts = Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}
    letters = {c for w in words for c in w}
    near = {}
    for w in words:
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = (out & words.keys()) - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(docs, **more):
    rows = spelling.variants(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, rows))


def test_random_words(make_docs):
    """Few letters, so that every kind of edit at every place occurs, and words that are prefixes of others."""
    rng = random.Random(2)
    words = ["".join(rng.choice("aabé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=60))) for k in range(120)]
    for least, times in ((1, 1), (3, 5)):
        assert got(make_docs(rows), least=least, times=times, factor=2, drop_every=7) == brute(rows, least, times, 7, 2)


def test_given_documents(spark, sf_dir, given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents").collect()]
    out = op13_spelling(spark, sf_dir)
    assert out.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    found = sorted(map(tuple, out.collect()))
    assert found == brute(rows) and any(r[1] for r in found)


def test_odd_tables(make_docs):
    long = "x" * 30_000
    rows = [(1, "Variéty variety " * 5), (2, None), (3, ""), (None, f"varieties {long} " * 6), (10**17 + 1, "variety2variety VARIETY ×÷×÷×÷ " * 9), (4, f"{long}y " * 40), (4, f"{long}y ")]
    assert got(make_docs(rows, clash=True)) == brute(rows)
    assert got(make_docs([])) == [] and got(make_docs([(1, "solitary " * 5)])) == [("solitary", None, "solitary", 5, 0, None)]


def test_chains_end_at_the_last_form(make_docs):
    rows = [(1, " ".join(w + " " for w, n in (("aaaaaa", 1), ("aaaaab", 5), ("aaaabb", 25), ("aaabbb", 125), ("aabbbb", 625)) for _ in range(n * 5)))]
    found = {r[0]: r[2] for r in got(make_docs(rows))}
    assert found["aaaaaa"] == "aabbbb" and got(make_docs(rows)) == brute(rows)


@pytest.mark.parametrize("a, b", [("", ""), ("abc", "abd"), ("abc", "abc"), ("abc", "abcd"), ("x", "y"), ("a" * 1000 + "b", "a" * 1000 + "c")])
def test_shared_prefix(a, b):
    n = spelling.shared(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])
