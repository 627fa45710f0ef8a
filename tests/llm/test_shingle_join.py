import random
import re

import numpy as np
import pytest

from gridcast.llm import shingle_join
from gridcast.llm.catalog import op11_shingle_join


def brute_set(text, width=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=4, percent=85):
    sets = [brute_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def got(docs, **more):
    return sorted(map(tuple, shingle_join.near_duplicates(docs, **more).collect()), key=str)


def corpus(seed, groups, size, copies, edits):
    """Groups of near copies of texts of many lengths, with a passage that many share, and some with many repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(1, size))]
        if rng.random() < 0.4:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [word()] if rng.random() < 0.7 else []
                text = text or [word()]
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def test_linked_sets_share_a_signature():
    """For all sizes, levels and frequency classes: sets at the threshold have a signature in common."""
    rng = np.random.default_rng(3)
    for turn in range(400):
        n = int(rng.choice([3, 7, 20, 63, 64, 70, 120, 127, 128, 300, 900]))
        universe = rng.integers(0, 2**63, 3 * n + 20).astype(np.uint64)
        many = dict(zip(universe.tolist(), rng.choice([2, 5, 17, 300, 600, 9000], len(universe), p=rng.dirichlet([1] * 6)).tolist()))
        x = set(rng.choice(universe, n, replace=False).tolist())
        m = int(rng.integers(-(-85 * n // 100), n + 1))
        both = -(-85 * (n + m) // 185)
        if both > m:
            continue
        y = set(rng.permutation(sorted(x))[:both].tolist()) | set(rng.choice(sorted(set(universe.tolist()) - x), m - both, replace=False).tolist())
        level = shingle_join.level(max(len(x), len(y)))
        sigs = []
        for s in (x, y):
            t = np.array(sorted(s), np.uint64)
            assert level in {shingle_join.level(len(s)), shingle_join.level(100 * len(s) // 85)}
            found, gone = shingle_join.signatures(t, np.array([many[v] for v in t.tolist()]), level, shingle_join.misses(len(s), 85))
            sigs.append(dict(zip(found.tolist(), gone.tolist())))
        shared = set(sigs[0]) & set(sigs[1])
        assert shared, (turn, n, m)
        # The bound that comes with one of them at least lets the pair pass.
        assert any(min(len(x) - sigs[0][s], len(y) - sigs[1][s]) >= both for s in shared)


@pytest.mark.parametrize("more", [{}, {"rare": (2, 4), "rounds": 1}, {"rare": (1,), "rounds": 0}])
def test_random_corpora(make_docs, more):
    rows = corpus(5, 60, 260, 9, 5)
    want = brute(rows)
    assert got(make_docs(rows), **more) == want and len({r[2] for r in want}) < len(rows)


def test_other_settings(make_docs):
    rows = corpus(8, 60, 40, 6, 6)
    assert got(make_docs(rows), width=2, percent=60) == brute(rows, 2, 60)


def test_given_documents(spark, sf_dir, given):
    rows = [(r["doc_id"], r["text"]) for r in given("documents").collect()]
    out = op11_shingle_join(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_odd_tables(make_docs):
    text = "one two three four five six seven eight nine ten " * 3
    long = " ".join(str(i) for i in range(30_000))
    rows = [(10**17 + 1, text), (None, text + "x"), (5, None), (6, ""), (7, " \t\n"), (8, "a b"), (9, "A  B"), (9, "A  B"), (10, "a b c"), (11, long), (12, long + " z"), (None, None), (None, "q"), (13, "é É"), (14, "É é")]
    assert got(make_docs(rows, clash=True)) == brute(rows)
    assert got(make_docs([])) == [] and got(make_docs([(3, "only one")])) == [(3, 1, 3)]


def test_a_chain_of_links_is_one_component(make_docs):
    """Neighbours link, the ends do not: leaders alone would not find every link."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 200])) for k in range(50)]
    assert got(make_docs(rows)) == brute(rows) and {r[2] for r in brute(rows)} == {0}
