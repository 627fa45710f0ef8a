import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridcast.llm import bpe
from gridcast.llm.catalog import WORD_BPE

ODD = [
    "", "   ", "Hello  WORLD\n\tagain", "don't we'll I'M they've 's", "a<|endoftext|>b <|startoftext|>", "<|x <| |>",
    "ΣΑΣ ÏİK ﬁ Å é", "​\xa0　x y\x1cz\x85", "12²½ 3a4", "\U0001f600\U0001f468‍\U0001f469", "한국어 भाषा العربية",
    "x" * 5000, "ab" * 20_000 + " " + "!?" * 3000, "\x00\x01", "_-_ --- ...", "The THE the",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def expect(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return ids, shown


def test_ids_and_text_equal_the_library(library, given):
    ours = bpe.Bpe(WORD_BPE)
    for text in ODD + [r["text"] for r in given("documents").collect()]:
        ids, shown = expect(library, text)
        assert ours.encode(text) == ids
        assert ours.decode(ids) == shown
        n, a, b = ours.digest(text)
        assert (n, a, b) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "STRETCHES", 3)
    monkeypatch.setattr(bpe, "WORDS", 2)
    ours = bpe.Bpe(WORD_BPE)
    text = "some words, some more words; and some of the words again " * 3
    assert ours.encode(text) == expect(library, text)[0]


def test_tables(make_docs, library):
    rows = [*enumerate(ODD), (99, None), (None, "no id"), (0, ""), (0, "")]
    got = bpe.digests(make_docs(rows, clash=True), WORD_BPE)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for k, t in rows:
        ids, shown = expect(library, t)
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    full = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode(make_docs(rows[:6]), WORD_BPE).collect()}
    assert full == {k: expect(library, t) for k, t in rows[:6]}
    assert bpe.digests(make_docs([]), WORD_BPE).count() == 0


def test_every_code_point_is_of_the_librarys_class(library):
    """Letters, numbers, other characters and small letters agree with the format's library over all of Unicode."""
    ours = bpe.Bpe(WORD_BPE)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(f"b{chr(c)}{chr(c)}1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, got in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ours.encode(text) == got.ids


def test_places_of_a_long_stretch_do_not_run_over():
    """A merge entry holds rank, id and place side by side; places go up to 2^40, more than a string can have."""
    ours, word = bpe.Bpe(WORD_BPE), "ab" * 40_000
    assert ours.decode(ours.merge(word)).replace(" ", "") == word + bpe.END
