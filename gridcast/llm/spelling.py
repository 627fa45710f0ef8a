"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie held as an edge table.

The trie has an edge table (node, label, child): nodes are the words and the prefixes at which words part, so an edge may
carry several letters and the depth is that of the branchings, not of the longest word. A state is (word, position, node,
edits). Every level joins the states with the edges of their node: an edge that agrees with the word is followed, an edge
that does not is followed with one edit. A state that has used its edit at the end of the word and on a node that is a
word makes the two words neighbours.

An edit that comes first among the letters where two words differ leaves equal letters before and after it. So either the
first half of the word is untouched, or what follows it is. Words are entered twice, forward and reversed, and edits are
allowed only behind the untouched part: states branch only deep in the trie, where nodes have few edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import whole
from gridcast.session import snapshot

# Fixed values of the word rule.
LETTER = "[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First letter of words as they are and of reversed words in the trie; neither begins a word otherwise
FORWARD, BACKWARD = ">", "<"


def typed_runs(docs: DataFrame, key: str, text: str, drop_every: int, least: int = 1) -> DataFrame:
    """word: every run of ``least`` letters or more, A-Z lower-cased, with a letter left out where the hash of key and run says so."""
    run = F.lit(f"{LETTER}{{{max(1, least)},}}")  # shorter runs end where the next character is no letter, so runs are whole
    runs = docs.select(F.col(key).cast("string").alias("k"), F.explode(F.regexp_extract_all(whole(text), run, F.lit(0))).alias("r"))
    # Lower-casing looks at A-Z alone; where all letters are ASCII that is what lower() does.
    low = runs.select("k", F.when(F.octet_length("r") == F.length("r"), F.lower("r")).otherwise(F.translate("r", CAPITALS, SMALL)).alias("r"))
    h = F.crc32(F.concat(F.coalesce("k", F.lit("")), F.lit(":"), "r").cast("binary"))
    at = (F.col("h") % F.length("r")).cast("int")
    cut = F.concat(F.substr("r", F.lit(1), at), F.substr("r", at + 2))
    return low.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("r")).alias("word"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 5, drop_every: int = 199) -> DataFrame:
    """word, n: words of ``least`` code points or more that occur ``times`` times or more."""
    words = typed_runs(docs, key, text, drop_every, least).filter(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def with_prefix(strings: DataFrame) -> DataFrame:
    """s, up: every distinct string with the length of the prefix it shares with the string before it in code-point order.

    Strings are dealt out by range and sorted there, so the order is global while no task sees more than its range. The
    first string of a range meets the last one of the range before it in a table of one row per range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            values, parts = batch.column(0).to_pylist(), batch.column(1)
            up = [None if last is None and i == 0 else shared(last if i == 0 else values[i - 1], v) for i, v in enumerate(values)]
            last = values[-1] if values else last
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(up, pa.int32()), parts], ["s", "up", "part"])

    dealt = strings.select("s").distinct().repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id())
    found = snapshot(dealt.mapInArrow(run, "s string, up int, part int"))
    # One row per range: its number is that of the shuffle's partitions.
    ends = found.groupBy("part").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    before = ends.agg(F.sort_array(F.collect_list(F.struct("part", "first", "last"))).alias("e"))
    meet = before.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("e")), lambda i: F.struct(F.get("e", i - 1).first.alias("s"), F.get("e", i - 2).last.alias("p")))).alias("x"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, p = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared(a, b or "") for a, b in zip(s, p)], pa.int32())], ["s", "up"])

    firsts = meet.select("x.s", "x.p").filter("s is not null").mapInArrow(join, "s string, up int")
    return found.filter("up is not null").select("s", "up").unionByName(firsts)


def edge_table(entries: DataFrame) -> DataFrame:
    """node, letter, label, child, n, after of the trie over ``entries`` (s, n).

    n is null where a child is no entry; after holds the first letters of the child's own edges, as a string.

    In code-point order the parent of a node is the prefix it shares with the node before it, because the prefixes at
    which entries part are nodes themselves.
    """
    parted = with_prefix(entries).filter("up > 0").select(F.substr("s", F.lit(1), F.col("up")).alias("s"))
    tops = entries.select(F.substr("s", F.lit(1), F.lit(1)).alias("s"))
    nodes = snapshot(with_prefix(entries.select("s").unionByName(parted).unionByName(tops)))
    cut = F.substr("s", F.col("up") + 1)
    letter = F.substr(cut, F.lit(1), F.lit(1))
    node = F.substr("s", F.lit(1), F.col("up"))
    # As many letters as the alphabet has, whatever the number of entries below a node.
    after = nodes.filter("up > 0").groupBy(node.alias("s")).agg(F.concat_ws("", F.collect_set(letter)).alias("after"))
    edges = nodes.filter("up > 0").join(entries, "s", "left").join(after, "s", "left")
    return edges.select(node.alias("node"), letter.alias("letter"), cut.alias("label"), F.col("s").alias("child"), "n", F.coalesce("after", F.lit("")).alias("after"))


def _from(at: Column, size: Column | None = None) -> Column:
    """The state's word from place ``at`` (counted from 0), ``size`` code points or all."""
    return F.substr("s", at + 1, size) if size is not None else F.substr("s", at + 1)


def neighbours(words: DataFrame) -> DataFrame:
    """word, near, n of every pair of words exactly one inserted, deleted or replaced code point apart, both ways round.

    ``words`` has word (distinct, not null) and n (of the neighbour, passed on). A word never is its own neighbour.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    entries = snapshot(
        words.select(F.concat(F.lit(FORWARD), "word").alias("s"), "n", (half + 1).alias("free")).unionByName(
            words.select(F.concat(F.lit(BACKWARD), F.reverse("word")).alias("s"), "n", (F.length("word") - half + 1).alias("free"))
        )
    )
    edges = snapshot(edge_table(entries.select("s", "n")))
    size, wide = F.length("s"), F.length("label")
    live = entries.select("s", "free", F.lit(1).alias("at"), F.substr("s", F.lit(1), F.lit(1)).alias("node"), F.lit(0).alias("edits"))
    done = []
    while True:
        at = F.col("at")
        # In the untouched part and behind its edit, a state can only go on along the letters of its word.
        own = live.filter("edits = 1 or at < free").withColumn("letter", _from(at, F.lit(1))).join(edges, ["node", "letter"])
        own = own.filter(F.col("label") == _from(at, wide)).select("s", "free", (at + wide).alias("at"), F.col("child").alias("node"), "edits", "n", "after")
        near = live.filter("edits = 0 and at >= free").join(edges, "node")
        follow = F.col("label") == _from(at, wide)
        rest = F.substr("label", F.lit(2))
        replaced = ~follow & (at < size) & (rest == _from(at + 1, wide - 1))
        inserted = ~follow & (rest == _from(at, wide - 1))
        deleted = ~follow & (at < size) & (F.col("label") == _from(at + 1, wide))
        kinds = [(follow, at + wide, 0), (replaced, at + wide, 1), (inserted, at + wide - 1, 1), (deleted, at + wide + 1, 1)]
        moves = F.array_compact(F.array(*[F.when(ok, F.struct(to.cast("int").alias("at"), F.lit(spent).alias("edits"))) for ok, to, spent in kinds]))
        moved = near.filter(follow | replaced | inserted | deleted).select("s", "free", F.col("child").alias("node"), "n", "after", F.explode(moves).alias("m"))
        moved = moved.select("s", "free", "m.at", "node", "m.edits", "n", "after")
        # A state behind its edit goes on only if its node ends with the word or has an edge with the word's next letter.
        hope = (F.col("edits") == 0) | F.when(at == size, F.col("n").isNotNull()).otherwise((at < size) & (F.instr(F.col("after"), _from(at, F.lit(1))) > 0))
        own, moved = own.filter(hope).drop("after"), moved.filter(hope).drop("after")
        live = snapshot(own.unionByName(moved))
        # At the end of the word, or one letter before it with the edit unspent: that letter is the one left out.
        ends = F.col("n").isNotNull() & ((F.col("edits") == 1) & (at == size) | (F.col("edits") == 0) & (at == size - 1) & (at >= F.col("free")))
        done.append(live.filter(ends).select("s", "node", "n", "free"))
        live = live.filter("at < length(s) or edits = 0").drop("n")
        if live.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    plain = lambda c: F.when(F.col(c).startswith(FORWARD), F.substr(c, F.lit(2))).otherwise(F.reverse(F.substr(c, F.lit(2))))
    pairs = found.select(plain("s").alias("word"), plain("node").alias("near"), "n", F.col("s").startswith(FORWARD).alias("ahead"))
    # Pairs that part behind the first half are those of the forward words already.
    half = F.floor(F.length("word") / 2).cast("int")
    new = F.substr("word", F.lit(1), half) != F.substr("near", F.lit(1), half)
    return pairs.filter(F.col("ahead") | new).drop("ahead")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, times: int = 5, drop_every: int = 199, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    A word's form is its neighbour of largest n (ties: the first in code-point order), if that n is ``factor`` times the
    word's or more; root follows forms to the last. Words are runs of letters, A-Z lower-cased; of the runs whose hash with
    the key divides by ``drop_every`` one letter is left out first. Missing and empty texts hold no words, a missing key
    reads as empty, repeated rows count again, an empty table gives an empty result, and other columns are ignored.
    """
    words = snapshot(vocabulary(docs, key, text, least, times, drop_every))
    best = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    known = words.join(best, "word", "left")
    takes = -F.col("b.less") >= factor * F.col("n")
    forms = snapshot(
        known.select("word", F.when(takes, F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("b.less")).alias("form_n"))
    )
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form. Each round doubles the steps taken; n grows along forms, so there is no way round."""
    ways = snapshot(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = snapshot(ways.join(further, "root", "left"))
        ways = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return ways
