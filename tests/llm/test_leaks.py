import random

import pytest

from gridcast.llm import leaks

ITEM = "What did the grey heron carry over the frozen river, and why did nobody in the village see it leave at dawn that day? " * 2


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM), (2, "A rather short item about herons."), (3, "tiny"), (4, None), (5, "  "), (None, "An item without any id is no item, whatever it says here."), (6, ITEM[:100] + "zebra"), (6, "Another row of the same item, long enough to be found anywhere.")]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, bench, **more):
    return sorted({(r["doc_id"], r["item_id"]) for r in leaks.leaks(docs, bench, **more).collect()}, key=str)


def typo(text, n, seed=0):
    rng, x = random.Random(seed), list(text)
    for i in range(n):
        at = (i * len(x)) // n + rng.randrange(3)
        x[min(at, len(x) - 1)] = "#"
    return "".join(x)


def brute_edits(piece, region):
    row = [0] * (len(region) + 1)
    for i, c in enumerate(piece, 1):
        new = [i]
        for j, r in enumerate(region, 1):
            new.append(min(row[j - 1] + (c != r), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_alignment_matches_plain_table():
    rng = random.Random(4)
    for _ in range(200):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        region = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
        want = brute_edits(piece, region)
        got = leaks.edits(piece, region, 6)
        assert (got[0] == want) if want <= 6 else got is None


def test_bands_are_aligned_side_by_side():
    """One alignment answers for many bands, each on its own diagonals and at the edges of its region."""
    rng, cases = random.Random(5), []
    for _ in range(300):
        piece = [rng.choice("ab") for _ in range(9)]
        region = [rng.choice("ab") for _ in range(rng.randint(1, 25))]
        low = rng.randint(-9, len(region))
        cases.append((piece, region, low, rng.randint(low, len(region))))
    letters = [[leaks.np.array([ord(c) for c in x], "i4") for x in side] for side in zip(*[(p, r) for p, r, _, _ in cases])]
    cost, end = leaks.edits_of_many(leaks.np.stack(letters[0]), letters[1], *[leaks.np.array(x) for x in zip(*[c[2:] for c in cases])])
    for (p, r, low, high), c, e in zip(cases, cost.tolist(), end.tolist()):
        best = leaks.edits("".join(p), "".join(r), 9, low, high)
        assert best == ((c, e) if c <= 9 else None)
        row = [0 if low <= j <= high else 99 for j in range(len(r) + 1)]  # the whole table, places off the diagonals left out
        for i, x in enumerate(p, 1):
            new = []
            for j in range(len(r) + 1):
                ways = [row[j] + 1, *([row[j - 1] + (x != r[j - 1]), new[j - 1] + 1] if j else [])]
                new.append(min(ways) if low <= j - i <= high else 99)
            row = new
        assert (min(row), row.index(min(row))) == (c, e) if min(row) < 99 else c >= 1 << 30


def test_a_text_is_aligned_once_for_all_its_bands(monkeypatch):
    index, calls, real = leaks.build([(1, ITEM)]), [], leaks.edits_of_many
    monkeypatch.setattr(leaks, "edits_of_many", lambda *a: calls.append(len(a[1])) or real(*a))
    assert leaks.leaks_in(index, typo(ITEM * 3, 20))[0][:2] == (1, index.counts[1])
    assert len(calls) == 1 and calls[0] > 5


def test_gram_codes_are_those_of_their_characters():
    text = "abcabcabdéabcabcabdé"
    for q in (1, 2, 3, 7, 10):
        codes = leaks.gram_codes(text, q).tolist()
        by = {}
        for i, c in enumerate(codes):
            by.setdefault(text[i : i + q], set()).add(c)
        assert len(codes) == len(text) - q + 1 and all(len(v) == 1 for v in by.values()) and len(set(codes)) == len(by)


def test_no_leak_within_the_budget_is_missed():
    """The lemma loses nothing: random texts with a piece edited up to its budget are all found."""
    rng = random.Random(9)
    for trial in range(60):
        item = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 8))) for _ in range(40))[:150].strip()
        index = leaks.build([(1, item)])
        x = list(index.pieces[0])
        for _ in range(int(index.budgets[0])):
            op, at = rng.random(), rng.randrange(len(x))
            if op < 0.4:
                x[at] = "#"
            elif op < 0.7:
                x.insert(at, "#")
            elif x[at] != " " and (at == 0 or x[at - 1] != " " or at + 1 == len(x) or x[at + 1] != " "):
                del x[at]
        noise = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(rng.randint(0, 200)))
        doc = leaks.normalise(noise + " " + "".join(x) + " " + noise)
        want = any(brute_edits(p, doc) <= b for p, b in zip(index.pieces, index.budgets))
        assert bool(leaks.leaks_in(index, doc)) == want


def test_leaks(make_docs, bench):
    around = "Some words before. "
    rows = [
        (1, around + ITEM + around), (2, around + ITEM.upper().replace(" ", "\n  ") + around), (3, around + typo(ITEM, 8) + around),
        (4, around + typo(ITEM, 80) + around), (5, around * 20), (6, "TINY "), (7, "tiny thing"), (8, None), (9, ""), (10, ITEM[:130] + around),
        (11, ITEM[:60] + around), (12, "x" * 300_000 + ITEM), (13, "a rather  short item about herons. " + around), (None, ITEM), (1, around + ITEM + around),
    ]
    got = found(make_docs(rows, clash=True), bench)
    assert {k for k, i in got if i == 1} == {1, 2, 3, 10, 12, None}
    assert {(6, 3), (13, 2)} <= set(got)
    assert {k for k, _ in got} == {1, 2, 3, 6, 10, 12, 13, None}
    assert found(make_docs(rows), bench, block=100) == got  # many blocks
    assert found(make_docs([]), bench) == [] and found(make_docs(rows), bench.limit(0)) == []


def test_long_documents_are_looked_at_in_overlapping_spans(monkeypatch):
    monkeypatch.setattr(leaks, "SPAN", 137)
    index = leaks.build([(1, ITEM)])
    for at in range(0, 400, 23):
        assert leaks.leaks_in(index, "y " * at + ITEM + " z" * 100)


def test_given_documents(given):
    docs, items = given("documents"), given("benchmark")
    got = set(found(docs, items))
    texts = {r["item_id"]: leaks.normalise(r["text"]) for r in items.collect()}
    exact = {(d["doc_id"], i) for d in docs.collect() for i, t in texts.items() if t in leaks.normalise(d["text"] or "")}
    assert exact <= got and len(exact) > 0
    for d, i in got - exact:
        text = leaks.normalise(next(r["text"] for r in docs.collect() if r["doc_id"] == d))
        index = leaks.build([(i, texts[i])])
        assert any(brute_edits(p, text) <= b for p, b in zip(index.pieces, index.budgets))


def test_drop_keeps_clean_rows_as_they_are(make_docs, bench):
    docs = make_docs([(10**17 + 1, "clean", None, "s"), (2, ITEM), (None, "clean too"), (None, ITEM), (3, None)], clash=True)
    kept = leaks.drop_leaks(docs, bench)
    assert kept.schema == docs.schema
    assert [r["doc_id"] for r in kept.collect()] == [10**17 + 1, None, 3]


def test_band_holds_every_alignment_on_its_diagonals():
    """On a band of diagonals the table finds what a plain table finds when it may only use those cells."""
    rng = random.Random(6)
    for _ in range(200):
        piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 15)))
        region = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        low = rng.randint(-3, 10)
        high = low + rng.randint(0, 8)
        far = 99
        row = [0 if low <= j <= high else far for j in range(len(region) + 1)]
        for i, c in enumerate(piece, 1):
            new = []
            for j in range(len(region) + 1):
                best = min(row[j] + 1, new[j - 1] + 1 if j else far, row[j - 1] + (c != region[j - 1]) if j else far)
                new.append(min(best, far) if low <= j - i <= high else far)
            row = new
        got = leaks.edits(piece, region, 6, low, high)
        assert (got[0] == min(row)) if min(row) <= 6 else got is None
