"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

An item is cut into overlapping pieces. A text within ``k`` edits of a piece of ``m`` characters shares at least
``m - q + 1 - k q`` of its q-grams with it, and these lie within ``k`` neighbouring diagonals. Shared q-grams are
counted in diagonal bands that overlap by half; a band that meets the bound is aligned, and only an alignment within the
edit budget counts. Documents are scanned where they are; the q-gram index of the benchmark goes to the tasks in blocks
of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole

Q = 10
#: Characters of a piece and between the starts of two pieces
PIECE, STEP = 120, 60
#: Edits allowed per character of a piece
RATE = 0.075
#: Characters of benchmark text whose index one task holds
BLOCK = 4 << 20
#: Characters of a document looked at together; neighbours overlap, so nothing is missed
SPAN = 1 << 20
#: Bands aligned side by side
ALIGNED = 1024
_BITS = 20


def normalise(text: str) -> str:
    """Lower case, every run of white space one space, no white space at the ends."""
    return " ".join(text.lower().split())


def gram_codes(text: str, q: int) -> np.ndarray:
    """A 64-bit code of the q characters at every place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < q:
        return np.zeros(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    power, width, code, taken, out = step, 1, c * np.uint64(0xD6E8FEB86659FD93), 0, None
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        left = q
        while left:
            if left & 1:  # take the next `width` characters into the sum
                part = code[taken : taken + len(c) - q + 1] * weight
                out = part if out is None else out + part
                taken += width
                weight = weight * power
            left >>= 1
            if left:
                code = code[:-width] + code[width:] * power
                width, power = 2 * width, power * power
    return out


def edits(piece: str, region: str, limit: int, low: int | None = None, high: int | None = None) -> tuple[int, int] | None:
    """Fewest edits that turn ``piece`` into some stretch of ``region``, and where that ends; None beyond ``limit``.

    Only places on the diagonals ``low`` to ``high`` count (place in the region less place in the piece; all if not given).
    """
    low = -len(piece) if low is None else max(low, -len(piece))
    high = len(region) if high is None else min(high, len(region))
    if high < low:
        return None
    p, r = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32) for t in (piece, region))
    cost, end = edits_of_many(p[None], [r], np.array([low]), np.array([high]))
    return (int(cost[0]), int(end[0])) if cost[0] <= limit else None


def edits_of_many(pieces: np.ndarray, regions: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits and first end of every piece (a row of ``pieces``, all of one length) in its region.

    Banded alignment of all of them side by side: one step per character of the pieces, in it only the places of a region
    on the diagonals ``low`` to ``high``, which lie between the piece's length below zero and the region's length. A piece
    without any alignment there costs 2^30 or more.
    """
    m, sizes = pieces.shape[1], np.array([len(r) for r in regions])
    width = int((high - low).max()) + 1
    far = 1 << 30  # more than any cost
    along = np.arange(width, dtype=np.int32)
    # Character i + j of a row is the one on its diagonal ``low + j`` in step i; -1 where the region has none.
    chars = np.full((len(regions), m + width), -1, np.int32)
    for k, (r, at) in enumerate(zip(regions, low.tolist())):
        part = r[max(at, 0) : max(at + m + width, 0)]
        chars[k, max(-at, 0) : max(-at, 0) + len(part)] = part
    place, last = (along + low[:, None]).astype(np.int32), sizes[:, None]
    outside = along > (high - low)[:, None]
    row = np.where((place >= 0) & (place <= last) & ~outside, 0, far).astype(np.int32)
    edges = bool(outside.any() or (low < 0).any() or (low + m + width - 1 > sizes).any())
    for i in range(m):
        new = row + (chars[:, i : i + width] != pieces[:, i : i + 1])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if edges:
            place += 1
            gone = outside | (place < 0) | (place > last)
            new[gone] = far
        row = np.minimum.accumulate(new - along, axis=1) + along
        if edges:
            row[gone] = far
    best = row.argmin(axis=1)
    return row[np.arange(len(row)), best], best + low + m


@dataclass
class Index:
    """Pieces of items and where each q-gram occurs in them."""

    items: list[int]  # item of every piece
    pieces: list[str]
    budgets: np.ndarray
    needs: np.ndarray  # shared q-grams a band must have
    grams: np.ndarray  # distinct codes, sorted
    first: np.ndarray  # of every code in the two lists below
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray
    whole: dict[str, list[int]]  # items too short for the lemma, by their text
    counts: dict[int, int]  # pieces of every item
    longest: int  # characters of the longest piece


def build(items: list[tuple[int, str]], q: int = Q, piece: int = PIECE, step: int = STEP, rate: float = RATE) -> Index:
    """Index of (id, text). An item shorter than q characters counts only as the whole of a document; an empty one never."""
    owners, pieces, short, counts = [], [], {}, {}
    for item, text in items:
        text = normalise(text or "")
        if not text:
            continue
        if len(text) < q:
            short.setdefault(text, []).append(item)
            continue
        starts = list(range(0, max(1, len(text) - piece + 1), step))
        if starts[-1] + piece < len(text):
            starts.append(len(text) - piece)
        for at in starts:
            owners.append(item)
            pieces.append(text[at : at + piece])
        counts[item] = counts.get(item, 0) + len(starts)
    size = np.array([len(p) for p in pieces], np.int64)
    budgets = np.minimum((size * rate).astype(np.int64), np.maximum(0, (size - q) // q))
    codes = [gram_codes(p, q) for p in pieces]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(pieces)), [len(c) for c in codes]) if codes else np.zeros(0, np.int64)
    place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << _BITS, bool)
    table[grams >> np.uint64(64 - _BITS)] = True
    return Index(owners, pieces, budgets, size - q + 1 - budgets * q, grams, np.append(first, len(flat)), owner[order], place[order], table, short, counts, max(map(len, pieces), default=0))


def _pieces_in(index: Index, text: str, q: int) -> Iterator[tuple[int, int, int]]:
    """(piece, edits, end) of the pieces found in a stretch of normalised text."""
    codes = gram_codes(text, q)
    at = np.flatnonzero(index.table[(codes >> np.uint64(64 - _BITS)).astype(np.int64)])
    if not len(at) or not len(index.grams):
        return
    spot = np.minimum(np.searchsorted(index.grams, codes[at]), len(index.grams) - 1)
    real = index.grams[spot] == codes[at]
    at, spot = at[real], spot[real]
    # A band needs so many hits within the length of a piece and its budget; places without them are left at once.
    reach = index.longest + int(index.budgets.max()) + q
    near = np.searchsorted(at, at + reach, "right") - np.searchsorted(at, at - reach, "left")
    at, spot = at[near >= index.needs.min()], spot[near >= index.needs.min()]
    n = index.first[spot + 1] - index.first[spot]
    if not n.sum():
        return
    pos = np.repeat(at, n)
    k = np.repeat(index.first[spot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    piece, place = index.owner[k], index.place[k]
    width = index.budgets[piece] + 1
    band = (pos - place) // width
    # Every hit is in two bands of twice the width. A q-gram of the piece counts once per band.
    seen = np.unique(np.stack([np.concatenate([piece, piece]), np.concatenate([band, band - 1]), np.concatenate([place, place])]), axis=1)
    edge = np.flatnonzero(np.any(seen[:2, 1:] != seen[:2, :-1], axis=0)) + 1
    starts = np.concatenate(([0], edge))
    count = np.diff(np.append(starts, seen.shape[1]))
    chosen = starts[count >= index.needs[seen[0, starts]]]
    if not len(chosen):
        return
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
    size = np.array([len(index.pieces[p]) for p in seen[0, chosen].tolist()])
    # Bands of pieces of one length are aligned side by side, so many at a time that their rows stay small.
    for m in np.unique(size):
        same = chosen[size == m]
        for at in range(0, len(same), ALIGNED):
            p, b = seen[0, same[at : at + ALIGNED]], seen[1, same[at : at + ALIGNED]]
            w = index.budgets[p] + 1
            low, ends = np.maximum(0, b * w), (b + 2) * w + m
            regions = [letters[i:k] for i, k in zip(low.tolist(), ends.tolist())]
            first = np.maximum(b * w - low, -m)
            last = np.minimum((b + 2) * w - 1 - low, [len(r) for r in regions])
            real = last >= first
            if not real.all():
                p, w, low, first, last, regions = p[real], w[real], low[real], first[real], last[real], [r for r, x in zip(regions, real) if x]
            if not len(p):
                continue
            pieces = np.frombuffer("".join(index.pieces[k] for k in p.tolist()).encode("utf-32-le", "surrogatepass"), np.int32)
            cost, end = edits_of_many(pieces.reshape(-1, m), regions, first, last)
            for k in np.flatnonzero(cost < w):
                yield int(p[k]), int(cost[k]), int(low[k] + end[k])


def leaks_in(index: Index, text: str, q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(item, pieces found, pieces of the item, fewest edits of a piece, end of the first) of one document."""
    text = normalise(text)
    best: dict[int, tuple[int, int]] = {}
    lap = index.longest * 2 + 4 * q
    for start in range(0, max(1, len(text)), SPAN):
        for p, cost, end in _pieces_in(index, text[start : start + SPAN + lap], q):
            best[p] = min(best.get(p, (cost, start + end)), (cost, start + end))
    found: dict[int, list[tuple[int, int]]] = {}
    for p, hit in best.items():
        found.setdefault(index.items[p], []).append(hit)
    out = [(item, len(h), index.counts[item], min(h)[0], min(e for _, e in h)) for item, h in sorted(found.items())]
    return out + [(item, 1, 1, 0, len(text)) for item in index.whole.get(text, [])]


def indexes(benchmark: DataFrame, item: str, passage: str, block: int) -> Iterator[Index]:
    """Indexes of the benchmark, one per block; only one block of text is on the driver at a time."""
    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), whole(passage).alias("p"))
    size = items.agg(F.coalesce(F.sum(F.length("p")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))
    for n in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n).orderBy("i", "p").collect()
        yield build([(r["i"], r["p"]) for r in part])


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document and benchmark item found in it: key, item, pieces_found, pieces, edits, end_char.

    Both texts are compared in lower case with single spaces; end_char counts characters of that form. A piece of an item
    (120 characters, or the whole of a shorter item) must occur within 7.5 % edits. Missing and empty texts match
    nothing, rows without an item id are no items, repeated documents are reported once each, repeated items as one with
    all their pieces. Empty tables give an empty result; other columns are ignored.

    The benchmark's size is asked for first. Up to ``block`` characters it is indexed once; beyond that it is dealt into
    blocks of about that size by hash of the item id, and documents are scanned once per block.
    """
    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    names = ["item_id", "pieces_found", "pieces", "edits", "end_char"]
    out = None
    for index in indexes(benchmark, item, passage, block):

        def run(batch: pd.DataFrame, index: Index = index) -> pd.DataFrame:
            at, found = [], []
            for n, t in enumerate(batch["t"]):
                hits = leaks_in(index, t)
                at += [n] * len(hits)
                found += hits
            return pd.DataFrame(np.array(found, np.int64).reshape(-1, 5), index=pd.Index(at, dtype="int64"), columns=names)

        hits = map_keyed(rows, run, ", ".join(f"{x} long" for x in names))
        out = hits if out is None else out.unionByName(hits)
    return out.select(F.col("id").alias(key), F.col("item_id").alias(item), *names[1:])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", passage: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage; all columns kept, every row judged by itself.

    Missing and empty texts hold none and stay, as do repeated rows without a passage; items without an id or text are no
    passages; empty tables remove nothing. Passages are found as in ``leaks``.
    """
    out = docs
    for index in indexes(benchmark, item, passage, block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not leaks_in(index, t or "") for t in texts], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
