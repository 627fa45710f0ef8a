"""Removal of bytes covered by long strings that also start elsewhere.

Which of all the corpus's strings of a fixed length repeat is found from a sample of suffixes with the property of a
difference cover: of any two equal strings, the sample holds a suffix at the same offset in both. The sample is chosen
by content (the least of the hashed 16-grams that start in the string's first ``spread`` bytes), which takes about two
suffixes per ``spread`` bytes. Sampled suffixes are named by their prefix, names that occur once are dropped, and only
where a name's occurrences differ around it does the same naming recur, on smaller parts, down to single strings.

1. Every document is cut into cells: neighbouring starts that share their sampled suffix. A cell has a name (the prefix
   of that suffix which all its strings contain) and a seal (everything its strings cover).
2. A name that occurs once settles its cell: nothing there repeats. A seal that occurs twice settles it too: everything
   repeats.
3. Other cells are cut into parts of a few neighbouring starts, at fixed distances from the sampled suffix. Parts are named
   (by what their strings share) and sealed anew, and judged like cells.
4. Parts that this leaves open are compared string by string, by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole
from gridcast.session import snapshot

GRAM = 16
SPREAD = 128
#: Starts in a part of a cell
PART = 8
#: Starts looked at together in a long document; cells end there, which costs comparisons but changes no result
SPAN = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)


def cells(data: bytes, length: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and sampled place of every cell of a document of at least ``length`` bytes."""
    a = np.frombuffer(data, np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(a, (len(a) - 7, 8), (1, 1))).view(np.uint64)[:, 0]
    n = len(a) - length + 1
    firsts, lasts, places = [], [], []
    for at in range(0, n, SPAN):
        size = min(SPAN, n - at)
        need = size + spread - 1
        h = words[at : at + need] * np.uint64(0x9E3779B97F4A7C15) ^ words[at + 8 : at + 8 + need] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # Least hash first, then leftmost. The place is only compared within a string, so it is content again.
        m = (h & ~_PLACE) | np.arange(need, dtype=np.uint64)
        span = 1
        while span * 2 <= spread:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < spread:
            m = np.minimum(m[: size + 0], m[spread - span : spread - span + size])
        place = (m[:size] & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        firsts.append(first + at)
        lasts.append(np.append(first[1:] - 1, size - 1) + at)
        places.append(place[first] + at)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(places)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def remaining(data: bytes, first: list[int], last: list[int], length: int) -> tuple[int, int, str]:
    """Removed bytes, removed runs and SHA-256 of the rest, when the strings at first..last repeat."""
    covered = np.zeros(len(data) + 1, np.int32)
    np.add.at(covered, np.asarray(first, np.int64), 1)
    np.add.at(covered, np.asarray(last, np.int64) + length, -1)
    gone = np.cumsum(covered)[:-1] > 0
    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
    return int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()


def _named(rows: DataFrame, length: int, spread: int) -> DataFrame:
    """name, seal, did, dh, cell (its number in the document) of every cell."""
    prefix = length - spread + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            names, seals, counts = [], [], []
            for data in batch["b"]:
                first, last, place = cells(data, length, spread)
                names += [digest(data[p : p + prefix]) for p in place.tolist()]
                seals += [digest(data[f : l + length], p - f) for f, l, p in zip(first.tolist(), last.tolist(), place.tolist())]
                counts.append(len(first))
            if counts:
                yield pd.DataFrame(
                    {
                        "name": _signed(names),
                        "seal": _signed(seals),
                        "did": np.repeat(batch["did"].to_numpy(), counts),
                        "dh": np.repeat(batch["dh"].to_numpy(), counts),
                        "cell": np.concatenate([np.arange(c, dtype=np.int32) for c in counts]),
                    }
                )

    long_enough = rows.filter(F.octet_length("b") >= length).select("did", "dh", "b")
    return long_enough.mapInPandas(run, "name long, seal long, did long, dh int, cell int")


def _judge(found: DataFrame, *place: str) -> tuple[DataFrame, DataFrame]:
    """From name, seal, weight and place: the (name, seal) that occur twice, and what stays open (place, weight).

    One occurrence of every seal of a name with several stands for it. Its weight is 2 if the seal repeats: then the
    strings there are settled, and only those of other seals are still compared with them.
    """
    seals = found.groupBy("name", "seal").agg(F.sum("weight").alias("times"), F.min(F.struct(*place)).alias("one"))
    seals = snapshot(seals)
    kinds = seals.groupBy("name").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("name")
    open_ = seals.join(kinds, "name").select("one.*", F.least("times", F.lit(2)).cast("int").alias("weight"))
    return seals.filter("times > 1").select("name", "seal"), open_


def _cell_lists(rows: DataFrame, length: int, spread: int) -> DataFrame:
    """Per document: ``same`` (cells whose strings all repeat) and ``open`` (cells to compare: number, weight)."""
    every = _named(rows, length, spread)
    names = every.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    shared = snapshot(every.join(names, "name"))
    twice, open_ = _judge(shared.withColumn("weight", F.lit(1)), "did", "dh", "cell")
    same = shared.join(twice, ["name", "seal"], "left_semi").groupBy("did", "dh").agg(F.collect_set("cell").alias("same"))
    return same.join(open_.groupBy("did", "dh").agg(F.collect_list(F.struct("cell", "weight")).alias("open")), ["did", "dh"], "full")


def _strings(marked: DataFrame, length: int, spread: int) -> DataFrame:
    """The open cells with their bytes: weight, did, dh, start, ahead (of the sampled place from there), bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for did, dh, data, todo in zip(batch["did"], batch["dh"], batch["b"], batch["open"]):
                first, last, place = cells(data, length, spread)
                for o in todo:
                    f, l, p = (int(x[o["cell"]]) for x in (first, last, place))
                    out.append((o["weight"], did, dh, f, p - f, data[f : l + length]))
            yield pd.DataFrame(out, columns=["weight", "did", "dh", "start", "ahead", "bytes"])

    kinds = "weight int, did long, dh int, start int, ahead int, bytes binary"
    return marked.filter(F.col("open").isNotNull()).select("did", "dh", "b", "open").mapInPandas(run, kinds)


def _parts(strings: DataFrame, length: int, part: int) -> DataFrame:
    """name, seal, weight, did, dh, start of the cell, at and upto (first and last start, counted from there) of its parts.

    Equal strings lie at the same distance before their sampled place, so in parts whose strings share the same bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            names, seals, rest = [], [], []
            for weight, did, dh, start, ahead, data in batch.itertuples(index=False):
                n = len(data) - length + 1
                for late in range(ahead % part, n + part - 1, part):
                    early = late - part + 1
                    f, l = max(early, 0), min(late, n - 1)
                    names.append(digest(data[late : early + length]))
                    seals.append(digest(data[f : l + length], late - f))
                    rest.append((weight, did, dh, start, f, l))
            frame = pd.DataFrame(rest, columns=["weight", "did", "dh", "start", "at", "upto"])
            frame.insert(0, "seal", _signed(seals))
            frame.insert(0, "name", _signed(names))
            yield frame

    cols = strings.select("weight", "did", "dh", "start", "ahead", "bytes")
    return cols.mapInPandas(run, "name long, seal long, weight int, did long, dh int, start int, at int, upto int")


def _repeats(strings: DataFrame, length: int, part: int) -> DataFrame:
    """Spans of repeated starts in the open cells."""
    parts = snapshot(_parts(strings, length, part))
    twice, open_ = _judge(parts, "did", "dh", "start", "at", "upto")
    whole_parts = parts.filter("weight = 1").join(twice, ["name", "seal"], "left_semi")
    todo = open_.groupBy("did", "dh", "start").agg(F.collect_list(F.struct("at", "upto", "weight")).alias("todo"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            rest, digests = [], []
            for did, dh, start, data, todo in batch.itertuples(index=False):
                for o in todo:
                    for q in range(o["at"], o["upto"] + 1):
                        digests.append(digest(data[q : q + length]))
                        rest.append((o["weight"], did, dh, start + q))
            frame = pd.DataFrame(rest, columns=["weight", "did", "dh", "at"])
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            frame.insert(0, "h2", h[:, 1])
            frame.insert(0, "h1", h[:, 0])
            yield frame

    left = strings.select("did", "dh", "start", "bytes").join(todo, ["did", "dh", "start"])
    each = snapshot(left.mapInPandas(run, "h1 long, h2 long, weight int, did long, dh int, at int"))
    again = each.groupBy("h1", "h2").agg(F.sum("weight").alias("n")).filter("n > 1").select("h1", "h2")
    single = each.filter("weight = 1").join(again, ["h1", "h2"], "left_semi")
    return whole_parts.select("did", "dh", (F.col("start") + F.col("at")).alias("first"), (F.col("start") + F.col("upto")).alias("last")).unionByName(
        single.select("did", "dh", F.col("at").alias("first"), F.col("at").alias("last"))
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 200, spread: int = SPREAD, part: int = PART) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus, in the same
    document included; strings never cross documents and are judged on the input. A missing text is empty; nothing goes
    from a text shorter than ``length``. Rows that repeat a document are documents of their own, so all of their bytes
    go. Missing keys pass through; rows are told apart by key and a hash of the text. An empty table gives an empty
    result; other columns are ignored.

    ``spread`` must lie between 16 and ``length`` - 16, ``part`` between 1 and ``length``.
    """
    if not GRAM <= spread <= length - GRAM:
        raise ValueError(f"spread must lie between {GRAM} and {length - GRAM}")
    if not 1 <= part <= length:
        raise ValueError(f"part must lie between 1 and {length}")
    rows = docs.select(F.col(key).alias("id"), whole(text).cast("binary").alias("b"))
    rows = rows.select("id", F.coalesce(F.col("id").cast("long"), F.xxhash64("b")).alias("did"), F.hash("b").alias("dh"), "b")
    lists = _cell_lists(rows, length, spread)
    # Documents without shared cells are done here; the others go on with their bytes.
    joined = rows.join(lists, ["did", "dh"], "left")
    marked = snapshot(
        joined.select(
            "id", "did", "dh", F.octet_length("b").cast("long").alias("n_bytes"),
            F.when(F.col("same").isNull() & F.col("open").isNull(), F.sha2("b", 256)).alias("sha"),
            F.when(F.col("same").isNotNull() | F.col("open").isNotNull(), F.col("b")).alias("b"),
            "same", "open",
        )
    )
    strings = snapshot(_strings(marked, length, spread))
    found = _repeats(strings, length, part).groupBy("did", "dh").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data, same, spans in zip(batch["b"], batch["same"], batch["found"]):
            first, last = [], []
            if same is not None and len(same):
                begin, end, _ = cells(data, length, spread)
                first, last = begin[same].tolist(), end[same].tolist()
            for s in [] if spans is None else spans:
                first.append(s["first"])
                last.append(s["last"])
            out.append(remaining(data, first, last, length))
        frame = pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])
        frame.insert(0, "n_bytes", batch["n_bytes"].to_numpy())
        return frame

    work = marked.filter("b is not null").join(found, ["did", "dh"], "left").select("id", "n_bytes", "b", "same", "found")
    cut = map_keyed(work, run, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("long")
    rest = marked.filter("b is null").select("id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256"))
    return cut.unionByName(rest).select(F.col("id").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")
