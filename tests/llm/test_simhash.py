import random
import re

import numpy as np
import pytest
import xxhash

from gridcast.llm import simhash
from gridcast.llm.graph import components


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, bits=2):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            r = find(i)
            least[r] = min(least.get(r, k), k)
    return sorted(((k, f"{prints[i]:016x}", least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


WORDS = [f"w{i}" for i in range(300)]


def corpus():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(80)]
    rows += [(100 + i, rows[i][1].upper() + " x") for i in range(20)] + [(200 + i, rows[i][1]) for i in range(5)]
    long = " ".join(rng.choices(WORDS, k=40_000))
    rows += [(300, long), (301, long + " tail"), (302, long.replace("w1 ", "w2 ", 3))]
    rows += [(400, ""), (401, None), (402, " \t\n"), (403, "one"), (404, "one two"), (405, "Éa é a"), (None, rows[3][1]), (None, "alone here now")]
    return rows + [rows[0], rows[0]]


@pytest.mark.parametrize("clash, subtrie", [(False, simhash.SUBTRIE), (True, 1)])
def test_components_match_brute_force(make_docs, clash, subtrie):
    rows = corpus()
    got = simhash.near_duplicates(make_docs(rows, clash), subtrie=subtrie)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_given_documents_match_brute_force(given):
    docs = given("documents")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def near_values(n, seed):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(3):
        v = np.concatenate([v, v[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))])
    return np.unique(np.concatenate([v, np.array([0, 1, 2, 3, 2**64 - 1, 2**63], np.uint64)]))


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_trie_finds_all_links(bits):
    v = near_values(300, bits)
    a, b = simhash.trie_links(v, None, bits)
    i, j = np.where(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= bits, 1))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(v[i].tolist(), v[j].tolist()))
    left, right = v[::2], v[1::2]
    a, b = simhash.trie_links(left, right, bits)
    i, j = np.where(np.bitwise_count(left[:, None] ^ right[None, :]) <= bits)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(left[i].tolist(), right[j].tolist()))


def test_distributed_walk_splits_crowded_subtries(spark):
    """All fingerprints share a long prefix, so the walk must go down far before anything is small."""
    base = 0x5A5A5A5A5A000000
    v = sorted({base + x for x in range(0, 400, 3)} | {base ^ (1 << 60), 5})
    df = spark.createDataFrame([(x,) for x in v], "fp long")
    got = sorted((min(r), max(r)) for r in simhash.links(df, 2, subtrie=8).collect())
    assert got == sorted((x, y) for i, x in enumerate(v) for y in v[i + 1 :] if (x ^ y).bit_count() <= 2)


def test_components_of_a_chain_a_star_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(-5, 900), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, -5: -5, 900: -5}


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_drop_keeps_the_smallest_of_every_component(make_docs):
    rows = [r for r in corpus() if r[0] is not None]
    docs = make_docs(rows, clash=True)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted({c for _, _, c in brute(rows)})
