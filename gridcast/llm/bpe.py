"""BPE encoding and decoding from a vocabulary file with word ends.

Merges run over a doubly linked list of symbols. A heap holds the rank of each adjacent pair; an entry whose pair has
meanwhile changed is stale and skipped. White space separates words, so every distinct stretch without white space is
encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole

#: Distinct stretches and words a worker remembers before it starts afresh; results do not depend on it
STRETCHES = 250_000
WORDS = 700_000
#: Words joined at once, so that long texts need no second copy of their ids
AT_ONCE = 1 << 16
# Fixed values of the tokenizer format
END = "</w>"
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")

# Letters and numbers of Unicode versions after the one in the format's library, as code point ranges.
NEWER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""
# Capitals whose small letters are newer than Python's tables; a span goes to as many places from the given one.
SMALL = "1c89>1c8a a7cb>264 a7cc>a7cd a7ce>a7cf a7d2>a7d3 a7d4>a7d5 a7da>a7db a7dc>19b 10d50-10d65>10d70 16ea0-16eb8>16ebb"
_LATER = "".join("-".join(chr(int(end, 16)) for end in span.split("-")) for span in NEWER.split())
WORD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|(?:[{_LATER}]|[^\s\p{{L}}\p{{N}}])+")


def _small() -> dict[int, int]:
    out = {ord("Σ"): ord("σ")}  # one character at a time: a final sigma is like any other
    for span, to in (pair.split(">") for pair in SMALL.split()):
        first, last = (int(end, 16) for end in (span.split("-") * 2)[:2])
        out |= {c: int(to, 16) + c - first for c in range(first, last + 1)}
    return out


_SMALL = _small()


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else one from 256 up."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A tokenizer read from ``path``: ``encode`` to ids, ``decode`` to the vocabulary strings joined by one space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        #: (left id, right id) as one number -> rank and merged id as one number
        self.merges = {
            vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(spec["model"]["merges"])
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, tuple[bytes, str]] = {}
        self.merged: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        data = word.encode("utf-8", "surrogatepass")
        inner, merges = self.inner, self.merges
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        # rank, merged id (20 bits), place (40 bits): least rank first, then leftmost
        heap = [m << 40 | i for i in range(n - 1) if (m := merges.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            at, m = top & 0xFFFFFFFFFF, top >> 40
            left, right = symbols[at], after[at]
            if left < 0 or right >= n or merges.get(left << 20 | symbols[right]) != m:
                continue  # stale
            symbols[at], symbols[right] = m & 0xFFFFF, -1
            after[at] = following = after[right]
            if following < n:
                ahead[following] = at
                if (m := merges.get(symbols[at] << 20 | symbols[following])) is not None:
                    heappush(heap, m << 40 | at)
            if (previous := ahead[at]) >= 0 and (m := merges.get(symbols[previous] << 20 | symbols[at])) is not None:
                heappush(heap, m << 40 | previous)
        return [s for s in symbols if s >= 0]

    def stretch(self, raw: str) -> tuple[bytes, str]:
        """Ids (32 bits each, in the machine's little-endian order) and decoded text of a stretch without white space."""
        text = raw.lower() if raw.isascii() else unicodedata.normalize("NFC", raw).translate(_SMALL).lower()
        ids = self.word(text) if text.isalpha() else b"".join(map(self.word, WORD.findall(text)))
        found = ids, self.decode(array("I", ids))
        if len(raw) <= 64:
            if len(self.known) >= STRETCHES:
                self.known.clear()
            self.known[raw] = found
        return found

    def word(self, word: str) -> bytes:
        """Ids of one lower-cased word, remembered unless it is very long."""
        if (ids := self.merged.get(word)) is None:
            ids = array("I", self.merge(word)).tobytes()
            if len(word) <= 64:
                if len(self.merged) >= WORDS:
                    self.merged.clear()
                self.merged[word] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def pieces(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of one run of words after the other; empty runs are left out."""
        get, make = self.known.get, self.stretch
        for part in self.marks.split(text) if "<|" in text else (text,):
            if (special := self.special.get(part)) is not None:
                yield special.to_bytes(4, "little"), self.strings[special]
                continue
            words = SPACE.split(part) if ODD_SPACE.search(part) else part.split()
            for at in range(0, len(words), AT_ONCE):
                found = [get(w) or make(w) for w in words[at : at + AT_ONCE] if w]
                ids = b"".join([f[0] for f in found])
                if ids:
                    yield ids, " ".join([f[1] for f in found if f[1]])

    def encode(self, text: str) -> list[int]:
        ids = b"".join(p[0] for p in self.pieces(text))
        return [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the decoded text."""
        n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for piece, shown in self.pieces(text):
            decoded.update((" " + shown if n else shown).encode("utf-8", "surrogatepass"))
            n += len(piece) // 4
            ids.update(piece)
        return n, ids.hexdigest(), decoded.hexdigest()


_loaded: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array of int), decoded (string) of every row; a missing or empty text has no ids and decodes to "".

    Missing keys pass through, repeated rows give repeated rows, an empty table an empty result. A stretch without white
    space may be as long as a string can be: its merges take memory in proportion.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        bpe = tokenizer(path)
        ids = [bpe.encode(t) for t in batch["t"]]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(i) for i in ids], dtype=object)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "ids array<int>, decoded string").select(F.col("id").alias(key), "ids", "decoded")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row, without shipping ids back.

    ``path`` is a vocabulary file every executor has. A missing text is empty: no ids, digests of nothing. Row order,
    repeated rows and other columns do not matter; an empty table gives an empty result.
    """

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        bpe = tokenizer(path)
        n, ids, decoded = zip(*[bpe.digest(t) for t in batch["t"]])
        return pd.DataFrame({"n_tokens": pd.Series(n, dtype="int64"), "ids_sha256": pd.Series(ids, dtype=object), "decoded_sha256": pd.Series(decoded, dtype=object)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    out = map_keyed(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.select(F.col("id").alias(key), "n_tokens", "ids_sha256", "decoded_sha256")
