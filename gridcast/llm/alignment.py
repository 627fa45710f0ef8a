"""Alignment of two tokenizers: tokens of both cut into groups where both end, links between overlapping tokens.

The cumulative byte ends of either token list become a dictionary from end to index. The keys that both dictionaries have,
sorted, are the places where tokens of both end; they slice the two id lists into groups. Within a slice every pair of
tokens that share a byte is a link. Links are counted for the whole corpus, and the counts are looked up again for the
links of every document.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.bpe import byte_letters
from gridcast.llm.common import map_keyed, whole
from gridcast.session import snapshot

#: Characters tokenized at once
AT_ONCE = 1 << 20
#: Id pairs whose counts one task holds
BLOCK = 1 << 20
_SHIFT = 32
NONE = np.zeros(0, np.int64)


class Pair:
    """Tokenizers A (a byte-level vocabulary file) and B (a piece model), with the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        back = {c: n for n, c in enumerate(byte_letters())}
        # A token with a character that stands for no byte is no result of ordinary text.
        known = {bytes(back[c] for c in s): i for s, i in vocab.items() if all(c in back for c in s)}
        # Ids of this format rise in the order of merges, which makes them ranks. No special tokens: their strings are text.
        # With a token for every byte, the tokens of A always are the bytes of the text.
        self.lossless = all(bytes([n]) in known for n in range(256))
        self.a = tiktoken.Encoding(a, pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a = [b""] * (max(known.values(), default=-1) + 1)
        for data, i in known.items():
            self.bytes_a[i] = data
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (list(map(len, x)) for x in (self.bytes_a, self.bytes_b))
        self.widths_a, self.widths_b = (np.array(x, np.int64) for x in (self.sizes_a, self.sizes_b))
        names = [b"%d%b" % (i, sign) for size, signs in ((len(self.bytes_a), (b",", b"|")), (len(self.bytes_b), (b",", b";"))) for i in range(size) for sign in signs]
        self.names = np.array(names, object)
        self.first_b = 2 * len(self.bytes_a)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8", "surrogatepass")

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of A for a space and the text and of B for the text; both empty where either's bytes are not those."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, data = self.a.encode_ordinary(" " + text), (" " + text).encode("utf-8", "surrogatepass")
            fits = text and b"".join(map(self.bytes_b.__getitem__, b)) == data
            fits = fits and (self.lossless or b"".join(map(self.bytes_a.__getitem__, a)) == data)
            yield (np.array(a, np.int64), np.array(b, np.int64)) if fits else (NONE, NONE)

    def all(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.encode(held)
                held, size = [], 0
        if held:
            yield from self.encode(held)

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where groups end: indexes after the last token of every group, in ``a`` and in ``b``."""
        ends_a = dict(zip(np.cumsum(self.widths_a[a]).tolist(), range(1, len(a) + 1)))
        ends_b = dict(zip(np.cumsum(self.widths_b[b]).tolist(), range(1, len(b) + 1)))
        # Ends were entered in rising order: the keys of one dictionary, looked up in the other, are sorted already.
        to_b = np.fromiter(map(ends_b.get, ends_a, repeat(0)), np.int64, len(ends_a))
        to_a = np.fromiter(ends_a.values(), np.int64, len(ends_a))
        return to_a[to_b > 0], to_b[to_b > 0]

    def links(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> np.ndarray:
        """Linked ids of every slice, one packed number (a, b) per link."""
        a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
        x = a << _SHIFT
        n, m = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        plain = (n == 1) | (m == 1)  # a token alone on its side overlaps all of the other
        group = np.repeat(np.arange(len(n)), n)  # of every token of A
        first, many = (to_b - m)[group], m[group]
        mixed = np.flatnonzero(~plain[group])
        if len(mixed):  # in other slices, the tokens of B that end behind the start of A's token and start before its end
            end_a, end_b = np.cumsum(self.widths_a[a]), np.cumsum(self.widths_b[b])
            first[mixed] = np.searchsorted(end_b, end_a[mixed] - self.widths_a[a[mixed]], "right")
            many[mixed] = np.searchsorted(end_b - self.widths_b[b], end_a[mixed], "left") - first[mixed]
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(x, many) | b[np.repeat(first, many) + k]

    def shown(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> bytes:
        """Groups as decimal ids: a1,a2|b1;a3|b2,b3. Every id is looked up together with the sign that follows it."""
        n, m = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[to_a - 1], sign_b[to_b - 1] = 1, 1  # the last of its group
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(to_b - m, n)] = 2 * a + sign_a
        out[np.arange(len(b)) + np.repeat(to_a, m)] = self.first_b + 2 * b + sign_b
        return b"".join(self.names[out].tolist())[:-1]


_loaded: dict[tuple[str, str], Pair] = {}


def pair(a: str, b: str) -> Pair:
    """One per worker process and pair of files."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Pair(a, b)
    return _loaded[a, b]


def groups(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, groups (array of a: ids, b: ids) of every row; an empty array where there are no tokens."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        two, out = pair(a, b), []
        for x, y in two.all(batch["t"]):
            cut_a, cut_b = two.align(x, y)
            out.append([{"a": x[i:k], "b": y[j:l]} for i, k, j, l in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b)])  # noqa: E741
        return pd.DataFrame({"groups": pd.Series(out, dtype=object)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "groups array<struct<a: array<int>, b: array<int>>>").select(F.col("id").alias(key), "groups")


def aligned(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (its distinct linked ids, packed), times (links of each)."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        two, out = pair(a, b), []
        for x, y in two.all(batch["t"]):
            if not len(x):
                out.append((0, 0, 0, 0, "", [], []))
                continue
            cut_a, cut_b = two.align(x, y)
            links = two.links(x, y, cut_a, cut_b)
            pairs, times = np.unique(links, return_counts=True)
            digest = hashlib.sha256(two.shown(x, y, cut_a, cut_b)).hexdigest()
            out.append((len(x), len(y), len(cut_a), len(links), digest, pairs, times))
        return pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links in the corpus), best (n is the highest of its B id, ties included) over ``aligned`` rows.

    Counts combine before the shuffle; the table grows with the pairs of ids that occur, not with the documents.
    """
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = snapshot(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n")))
    low = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    tops = counts.groupBy(low.alias("b")).agg(F.max("n").alias("top"))
    return snapshot(counts.withColumn("b", low).join(tops, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def _blocks(counts: DataFrame, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The table in parts of about ``block`` pairs: sorted pairs, counts, best. One part at a time is on the driver."""
    parts = max(1, -(-counts.count() // block))
    for part in range(parts):
        chosen = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == part).toArrow()
        p, n, best = (chosen.column(i).to_numpy() for i in range(3))
        order = np.argsort(p)
        yield p[order], n[order], best[order]


def align(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space. A missing or empty text, and one whose tokens
    of A or B are not the bytes of space and text, has no tokens: zeros, and an empty string instead of a digest. An id
    pair counts how many links of the whole corpus hold it; n_best counts links whose count is the highest of their B id,
    ties included; count_sum adds the counts up over links. Repeated rows count again, missing keys pass through, an empty
    table gives an empty result, and other columns are ignored.

    The counts go to the tasks in blocks of ``block`` id pairs at most on average, however many there are; documents are
    read once and pass all blocks one after the other, without a shuffle.
    """
    found = snapshot(aligned(docs, a, b, key, text))
    zero = F.lit(0).cast("long")
    out = found.withColumn("n_best", zero).withColumn("count_sum", zero)
    for table in _blocks(pair_counts(found), block):

        def run(batches: Iterator[pa.RecordBatch], table: tuple = table) -> Iterator[pa.RecordBatch]:
            pairs, counts, best = table
            for batch in batches:
                names = batch.schema.names
                at, times = batch.column(names.index("pairs")), batch.column(names.index("times"))
                x, t = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(at)), np.asarray(at.value_lengths()))
                if len(x) and len(pairs):
                    spot = np.minimum(np.searchsorted(pairs, x), len(pairs) - 1)
                    here = pairs[spot] == x
                    spot, t, owner = spot[here], t[here], owner[here]
                    sums, bests = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                    np.add.at(sums, owner, counts[spot] * t)
                    np.add.at(bests, owner, best[spot] * t)
                    add = {"count_sum": sums, "n_best": bests}
                    columns = [pa.array(c.to_numpy() + add[n]) if n in add else c for n, c in zip(names, batch.columns)]
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

        out = out.mapInArrow(run, out.schema)
    return out.select(F.col("id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
