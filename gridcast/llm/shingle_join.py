"""Jaccard self-join of documents on word shingles by token-combination prefixes, and the components of its links.

A document is the set of its distinct shingles, held as 64-bit tokens. Documents of equal sets are one class and take
part once.

1. Sifting. Of any two linked sets, the prefixes in hash order that are ``slack`` tokens longer than the threshold asks
   share more than ``slack`` tokens. A class whose prefix holds fewer tokens that any other class's prefix has, has no link.
2. Signatures. The tokens of the others are ordered by how many classes hold them, rare ones first, and put into frequency
   classes: tokens of the k-th frequency class count in combinations of k, formed inside groups that a hash deals them to.
   A prefix is extended until, in every group of k-combinations, the c tokens it has there leave c - k + 1 that can all
   be missing elsewhere only if more tokens are missing than the threshold allows. Linked sets then share a combination.
3. Verification. Candidates are compared by the shingles themselves, as text.

Candidates are not all pairs of a signature: at first every class of a signature meets one leader, and what links is one
component. Only classes of different components that share a signature, and can reach the threshold by the number of their
tokens that any other class has, are then compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import map_keyed, whole
from gridcast.llm.graph import components
from gridcast.session import snapshot

#: Most classes that hold a token of the first, second, ... frequency class; rarer tokens count alone, others together
RARE = (16, 512)
#: Sets below this size have no groups: all their tokens count alone
PLAIN = 64
#: Tokens of a set per group of a frequency class
SPREAD = 16
#: Rounds in which the classes of a signature meet one leader each
ROUNDS = 2
_WORDS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str, width: int) -> set[bytes]:
    """Distinct shingles; the whole sequence where it is shorter; none without words."""
    words = words_of(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokens:
    """Sorted distinct 64-bit tokens of texts; hashes of words are remembered."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > _WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.width, len(words))
        n = len(words) - size + 1
        with np.errstate(over="ignore"):
            t = np.full(n, size, np.uint64)
            for j in range(size):
                t = t * _MIX + h[j : j + n]
            return np.unique(_stir(t))


def misses(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that a linked set can lack: the overlap is ``percent`` % of the larger set or more."""
    return n - -(-percent * n // 100)


def level(n: int) -> int:
    return n.bit_length()


def groups_at(at: int) -> int:
    """Groups of a frequency class for sets of a size level; 0: every token counts alone."""
    return (1 << (at - 1)) // SPREAD if 1 << (at - 1) >= PLAIN else 0


def signatures(tokens: np.ndarray, many: np.ndarray, at: int, spare: int, rare: tuple[int, ...] = RARE) -> tuple[np.ndarray, np.ndarray] | None:
    """Signatures of a set at a size level, and for each how many of ``tokens`` are missing elsewhere if it is the first.

    ``tokens`` are those that other classes hold too, ``many`` the number of classes that do, ``spare`` how many more of
    them may be missing. Of the signatures that two sets share, one is complete first in the order of tokens; before it,
    every group had fewer common tokens than its combinations have, so the others it had by then are missing. None stands
    for a set whose tokens cannot be missing that often; it cannot occur where groups are as large as ``groups_at`` makes
    them.
    """
    order = np.lexsort((tokens, many))
    tokens, many = tokens[order], many[order]
    groups = groups_at(at)
    seed = np.uint64(at)
    if not groups:
        with np.errstate(over="ignore"):
            found = _stir(tokens[: spare + 1] + seed * _MIX)
        return (found, np.arange(len(found))) if len(tokens) > spare else None
    size = np.searchsorted(np.array(rare), many, "left") + 1  # tokens of a combination
    group = (size.astype(np.int64) - 1) * groups + (_stir(tokens ^ _MIX) % np.uint64(groups)).astype(np.int64)
    group[size == 1] = -1
    held: dict[int, list[int]] = {}
    left, out, gone = spare + 1, [], []
    for i, (g, k) in enumerate(zip(group.tolist(), size.tolist())):
        if g < 0:
            out.append((i,))
            left -= 1
        else:
            mates = held.setdefault(g, [])
            out.extend((*c, i) for c in combinations(mates, k - 1))
            mates.append(i)
            left -= len(mates) >= k
        gone += [spare - left] * (len(out) - len(gone))
        if left == 0:
            break
    if left:
        return None
    found = np.zeros(len(out), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, len(rare) + 2):
            which = [j for j, c in enumerate(out) if len(c) == k]
            if which:
                part = np.sort(tokens[np.array([out[j] for j in which], np.int64)], axis=1)
                h = np.full(len(which), k, np.uint64) + seed
                for j in range(k):
                    h = _stir(h * _MIX + part[:, j])
                found[which] = h
    found, first = np.unique(found, return_index=True)
    return found, np.array(gone)[first]


def _prepared(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """row, id, h (hash of the text), n, d1, d2 (digest of the set), head (its first tokens in hash order), slack."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        tokens, out = Tokens(width), []
        for t in batch["t"]:
            x = tokens(t)
            slack = len(x) // 20
            d = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8")
            out.append((len(x), d[0], d[1], x[: misses(len(x), percent) + 1 + slack].view(np.int64), slack))
        return pd.DataFrame(out, columns=["n", "d1", "d2", "head", "slack"], index=batch.index)

    rows = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(whole(text)).alias("h")).alias("k"), whole(text).alias("t"))
    found = map_keyed(rows, run, "n long, d1 long, d2 long, head array<long>, slack int")
    return snapshot(found.select(F.monotonically_increasing_id().alias("row"), "k.*", "n", "d1", "d2", "head", "slack"))


def _sifted(prepared: DataFrame, classes: DataFrame) -> DataFrame:
    """rep of the classes whose prefix holds more than ``slack`` tokens that prefixes of other classes hold."""
    heads = prepared.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "slack", F.explode("head").alias("token"))
    shared = heads.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("token")
    hits = heads.join(shared, "token").groupBy("row", "slack").agg(F.count(F.lit(1)).alias("hits"))
    return hits.filter("hits > slack").select(F.col("row").alias("rep"))


def _texts(docs: DataFrame, prepared: DataFrame, reps: DataFrame, key: str, text: str) -> DataFrame:
    """rep, t: the texts of the classes ``reps`` (rep, a row number of ``prepared``), found by key and hash."""
    wanted = prepared.select(F.col("row").alias("rep"), F.col("id").alias("i"), F.col("h").alias("hh")).join(reps, "rep")
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole(text)).alias("h"), whole(text).alias("t"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("hh")))
    return found.select("rep", "t").dropDuplicates(["rep"])


def _signed(live: DataFrame, width: int, percent: int, rare: tuple[int, ...]) -> DataFrame:
    """sig, rep, n, able (tokens that other classes hold), most (common tokens if no signature comes before) of ``live``."""

    def tokens_of(batch: pd.DataFrame) -> pd.DataFrame:
        make = Tokens(width)
        return pd.DataFrame({"x": pd.Series([make(t).view(np.int64) for t in batch["t"]], dtype=object)})

    every = snapshot(map_keyed(live.select("rep", "t"), tokens_of, "x array<long>"))
    each = every.select("rep", F.explode("x").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    held = each.join(counts, "token").groupBy("rep").agg(F.collect_list(F.struct("token", "many")).alias("held"))
    sized = every.select("rep", F.size("x").cast("long").alias("n")).join(held, "rep")

    def sign(batch: pd.DataFrame) -> pd.DataFrame:
        sigs, at, sizes, able, most = [], [], [], [], []
        for i, (n, held) in enumerate(zip(batch["n"].tolist(), batch["held"])):
            token = np.fromiter((h["token"] for h in held), np.int64, len(held)).view(np.uint64)
            many = np.fromiter((h["many"] for h in held), np.int64, len(held))
            spare = misses(n, percent) - (n - len(held))  # tokens that no other class holds are missing already
            if spare < 0:
                continue
            for lv in sorted({level(n), level(100 * n // percent)}):
                found = signatures(token, many, lv, spare, rare)
                if found is None:  # cannot be: see groups_at
                    raise ValueError(f"a set of {n} has no prefix at level {lv}")
                found, gone = found
                most.append(len(held) - gone)
                sigs.append(found.view(np.int64))
                at.append(np.full(len(found), i))
                sizes.append(np.full(len(found), n))
                able.append(np.full(len(found), len(held)))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pd.DataFrame({"sig": join(sigs), "n": join(sizes), "able": join(able), "most": join(most)}, index=pd.Index(join(at), dtype="int64"))

    found = map_keyed(sized, sign, "sig long, n long, able long, most long")
    return snapshot(found)


def _possible(percent: int, a: str, b: str):
    """Sizes, and the tokens that can be common if this signature is the first, allow a link of the rows ``a`` and ``b``."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = percent * (x + y)  # overlap * (100 + percent) must reach this
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * F.least(F.col(f"{a}.most"), F.col(f"{b}.most")) >= need)


def _linked(pairs: DataFrame, live: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets of shingles, compared as text, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x != last:
                    last, held = x, shingles(x, width)
                other = shingles(y, width)
                both = len(held & other)
                ok.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = live.select(F.col("rep").alias("a"), F.col("t").alias("ta"))
    two = live.select(F.col("rep").alias("b"), F.col("t").alias("tb"))
    rows = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "a long, b long")


def class_components(live: DataFrame, width: int, percent: int, rare: tuple[int, ...] = RARE, rounds: int = ROUNDS) -> DataFrame:
    """v, root of the classes ``live`` (rep, t) that are linked with another."""
    signed = _signed(live, width, percent, rare)
    links, roots = None, None
    for turn in range(rounds + 1):
        rows = signed.withColumn("root", F.col("rep")) if roots is None else signed.join(roots, signed["rep"] == roots["v"], "left").select("sig", "rep", "n", "able", "most", F.coalesce("root", "rep").alias("root"))
        if turn < rounds:
            # One leader per signature, another one each time; its own component is settled with it. The first leader is
            # the class with the smallest share of tokens of its own: what near copies were made from, if it is there.
            own = F.floor((F.col("n") - F.col("able")) * 1000 / F.col("n")) if turn == 0 else F.lit(0)
            first = F.min(F.struct(own.alias("own"), F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "n", "most", "root")).alias("l")
            leaders = rows.groupBy("sig").agg(first, F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("sig", "l")
            ok = (F.col("x.root") != F.col("l.root")) & _possible(percent, "x", "l")
            pairs = rows.alias("x").join(leaders, "sig").filter(ok)
            pairs = pairs.select(F.least("x.rep", "l.rep").alias("a"), F.greatest("x.rep", "l.rep").alias("b"))
        else:
            # Of two classes in different components one at least is outside the component that the signature's leader is in.
            first = F.min_by("root", F.xxhash64("rep")).alias("main")
            split = rows.groupBy("sig").agg(first, F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("sig", "main")
            left = rows.join(split, "sig")
            ok = (F.col("x.root") != F.col("y.root")) & _possible(percent, "x", "y")
            pairs = left.filter("root <> main").alias("x").join(left.alias("y"), "sig").filter(ok)
            pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        found = snapshot(_linked(snapshot(pairs.distinct()), live, width, percent))
        links = found if links is None else links.unionByName(found)
        if turn == 0 or not found.isEmpty():
            roots = snapshot(components(links))
    return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, rare: tuple[int, ...] = RARE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles (size of its set), component_id (smallest key reachable over links).

    Two rows are linked if ``100 * intersection >= percent * union`` of their sets of distinct shingles of ``width`` words.
    A-Z are lower-cased, words are runs without ASCII white space; a text of fewer words is one shingle. A missing text or
    one without words has an empty set, which is linked with nothing: its component is its own key. Rows without a key
    take part, but name no component (null if the whole component has no key); repeated rows are equal sets. An empty
    table gives an empty result; other columns are ignored. ``percent`` is above 50.

    Sets are told apart by 64-bit tokens and a 128-bit digest; links are decided on the shingles as text.
    """
    prepared = _prepared(docs, key, text, width, percent)
    sets = prepared.filter("n > 0")
    classes = snapshot(sets.groupBy("n", "d1", "d2").agg(F.min("row").alias("rep"), F.min("id").alias("least")))
    reps = snapshot(_sifted(prepared, classes))
    live = snapshot(_texts(docs, prepared, reps, key, text))
    roots = class_components(live, width, percent, rare, rounds)
    rooted = classes.join(roots, classes["rep"] == roots["v"], "left").select("n", "d1", "d2", "least", F.coalesce("root", "rep").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(named, "root").select("n", "d1", "d2", "component_id")
    full = sets.join(member, ["n", "d1", "d2"]).select("id", "n", "component_id")
    out = full.unionByName(prepared.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
