"""SimHash near-duplicates: fingerprints, a binary-trie self-join over them, and connected components.

The trie is walked from the root in pairs of nodes. Each step splits a pair by its next bits, adds up the bits that
differ and drops the pair once more than the budget differ. The upper levels are DataFrame joins of node pairs with their
children; a pair whose two subtries are both small enough goes to one task, which walks on in numpy. Only distinct
fingerprints take part, so copies cost nothing and no list of documents ever meets in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole
from gridcast.llm.graph import components
from gridcast.session import snapshot

SEED = 42
#: Bits by which the distributed walk goes down at once
STEP = 4
#: Most fingerprints of a subtrie that one task takes
SUBTRIE = 32_768
#: Pairs of small nodes are compared directly below this many comparisons
DIRECT = 64
_SLICE = 1 << 15


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits; a bit is set if over half of the shingle hashes have it. Signed, as Spark stores it."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    stops = np.cumsum(width + 1) - 1
    starts = stops - width
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        left, right = starts[at : min(n, at + _SLICE)].tolist(), stops[at + shingle - 1 :][: min(n - at, _SLICE)].tolist()
        if len(words) < shingle:
            right = [len(joined)]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(left, right)), np.uint64, len(left))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """key, fp (signed long) of every row; a text without words, or a missing one, has fp 0."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fp": np.array([fingerprint(t, shingle) for t in batch["t"]], np.int64)})

    rows = docs.select(F.col(key).alias("id"), whole(text).alias("t"))
    return map_keyed(rows, run, "fp long").select(F.col("id").alias(key), "fp")


class _Trie:
    """Nodes of one level of the trie over sorted distinct values: ranges that share their leading bits."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.lo = np.zeros(1, np.int64)
        self.hi = np.array([len(values)], np.int64)

    def down(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Go from ``depth`` to the next level; each old node's child by bit 0 and by bit 1, or -1."""
        keys = self.values >> np.uint64(63 - depth)
        lo = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        hi = np.append(lo[1:], len(keys))
        first = np.searchsorted(lo, self.lo)
        bit = (keys[lo[first]] & np.uint64(1)).astype(bool)
        after = np.minimum(first + 1, len(lo) - 1)
        second = (first + 1 < len(lo)) & (lo[after] < self.hi)
        self.lo, self.hi = lo, hi
        return np.where(bit, -1, first), np.where(bit, first, np.where(second, after, -1))


def trie_links(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct values at ``bits`` differing bits or fewer: within ``left``, or between it and ``right``.

    Both are distinct unsigned values. Walks two tries level by level, all live node pairs of a level at once.
    """
    a = np.sort(left)
    same = right is None
    b = a if same else np.sort(right)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(a) == 0 or len(b) == 0:
        return a[:0], b[:0]
    one, two = _Trie(a), _Trie(b)
    p, q, spent = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(65):
        if not len(p):
            break
        sizes = (one.hi - one.lo)[p] * (two.hi - two.lo)[q]
        small = (sizes <= DIRECT) | (depth == 64)
        if small.any():
            at, n = np.flatnonzero(small), sizes[small]
            pair = np.repeat(np.arange(len(at)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            wide = (two.hi - two.lo)[q[at]][pair]
            x, y = one.lo[p[at]][pair] + k // wide, two.lo[q[at]][pair] + k % wide
            near = np.bitwise_count(a[x] ^ b[y]) <= bits
            near &= x < y if same else a[x] != b[y]
            found.append((a[x[near]], b[y[near]]))
            p, q, spent = p[~small], q[~small], spent[~small]
            if not len(p):
                break
        kids = one.down(depth)
        others = kids if same else two.down(depth)
        if same:
            two.lo, two.hi = one.lo, one.hi
        grown = []
        for i in (0, 1):
            for j in (0, 1):
                x, y = kids[i][p], others[j][q]
                ok = (x >= 0) & (y >= 0) & (spent + (i != j) <= bits)
                if same and (i, j) == (1, 0):
                    ok &= p != q  # a node paired with itself has this pair once already
                grown.append((x[ok], y[ok], spent[ok] + (i != j)))
        p, q, spent = (np.concatenate(c) for c in zip(*grown))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (a[:0], b[:0])


def _prefix(depth: int):
    return F.shiftrightunsigned(F.col("fp"), 64 - depth) if depth < 64 else F.col("fp")


def links(prints: DataFrame, bits: int = 2, subtrie: int = SUBTRIE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in 1 to ``bits`` bits, each pair once. ``prints`` has fp.

    A pair of subtries is split further while either holds more than ``subtrie`` fingerprints, so a prefix that very
    many share is no larger task than others. The driver only learns whether such pairs are left.
    """
    spark = prints.sparkSession
    prints = snapshot(prints.select("fp").filter("fp is not null").distinct())
    live = spark.range(1).select(F.col("id").alias("p"), F.col("id").alias("q"))  # the root with itself
    leaves = []
    for depth in range(STEP, 65, STEP):
        nodes = prints.groupBy(_prefix(depth).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        nodes = nodes.withColumn("up", F.shiftrightunsigned("x", STEP))
        one = nodes.select(F.col("up").alias("p"), F.col("x").alias("x1"), F.col("n").alias("n1"))
        two = nodes.select(F.col("up").alias("q"), F.col("x").alias("x2"), F.col("n").alias("n2"))
        near = F.bit_count(F.col("x1").bitwiseXOR(F.col("x2"))) <= bits
        once = (F.col("p") != F.col("q")) | (F.col("x1") <= F.col("x2"))
        pairs = snapshot(
            live.join(one, "p").join(two, "q").filter(near & once).select(F.col("x1").alias("p"), F.col("x2").alias("q"), "n1", "n2")
        )
        small = (F.col("n1") <= subtrie) & (F.col("n2") <= subtrie) | F.lit(depth == 64)
        ready = pairs.filter(small).select("p", "q")
        at = prints.withColumn("x", _prefix(depth))
        leaves += [
            at.join(ready.withColumnRenamed("p", "x"), "x").select(F.lit(depth).alias("depth"), F.col("x").alias("p"), "q", F.lit(0).alias("side"), "fp"),
            at.join(ready.filter("p <> q").withColumnRenamed("q", "x"), "x").select(F.lit(depth).alias("depth"), "p", F.col("x").alias("q"), F.lit(1).alias("side"), "fp"),
        ]
        live = pairs.filter(~small).select("p", "q")
        if live.isEmpty():
            break
    work = leaves[0]
    for more in leaves[1:]:
        work = work.unionByName(more)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        values, side = group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy()
        own = group["p"].iat[0] == group["q"].iat[0]
        x, y = trie_links(values[side == 0], None if own else values[side == 1], bits)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return work.groupBy("depth", "p", "q").applyInPandas(walk, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2, subtrie: int = SUBTRIE
) -> DataFrame:
    """One row per row of ``docs``: key, fingerprint (16 hex digits), component_id (smallest key reachable over links).

    A-Z are lower-cased, words are runs without ASCII white space. A text of fewer words than a shingle is one shingle;
    a missing text or one without words has fingerprint zero and links like any other. Rows without a key take part, but
    name no component (null if the whole component has no key). An empty table gives an empty result; other columns are
    ignored. Repeated rows share one fingerprint.
    """
    prints = snapshot(fingerprints(docs, key, text, shingle))
    classes = snapshot(prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(classes, bits, subtrie))
    rooted = classes.join(roots, classes["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(member, "fp").select(key, shown, "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` with the row of the smallest key of every component; all columns kept.

    A component without any key stays whole: nothing names one of its rows. Rows that repeat the key that stays are one
    document and leave one row.
    """
    found = near_duplicates(docs, key, text, shingle, bits)
    stay = found.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("id_")).distinct()
    kept = docs.join(stay, docs[key].eqNullSafe(stay["id_"]), "left_semi")
    known = kept.filter(F.col(key).isNotNull()).dropDuplicates([key])
    return known.unionByName(kept.filter(F.col(key).isNull())).select(*docs.columns)
