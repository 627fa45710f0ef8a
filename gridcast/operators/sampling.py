"""Exact-size, reproducible samples. Row choice follows the md5 of key and seed; sizes and quotas are exact."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridcast.functions.hashing import hash_slice, key_hash
from gridcast.operators.ranking import cut_of, digits_for, hash_bucket, position, running_count, take_first


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if fewer), without replacement."""
    hashed = df.withColumn("_hash", key_hash(keys, seed))
    return take_first(hashed, n, ["_hash", *keys], hash_bucket(F.col("_hash"))).drop("_hash")


def _ranked(df: DataFrame, by: Sequence[str], keys: Sequence[str], seed: int, name: str) -> DataFrame:
    """Every row is ranked, so the buckets are sized by a row count (a job that reads no columns it can avoid)."""
    digits = digits_for(df.count())
    hashed = df.withColumn("_hash", key_hash(keys, seed))
    return position(hashed, ["_hash", *keys], hash_bucket(F.col("_hash"), digits), by=by, name=name).drop("_hash")


def shuffle_rows(df: DataFrame, keys: Sequence[str], seed: int = 42, name: str = "position") -> DataFrame:
    """Seeded permutation, kept as a rank column because a distributed table has no row order of its own."""
    return _ranked(df, (), keys, seed, name)


def rank_in_stratum(
    df: DataFrame, stratum: str, keys: Sequence[str], seed: int = 42, name: str = "rank"
) -> DataFrame:
    """Seeded rank inside each stratum; a stratum may hold any share of the rows."""
    return _ranked(df, [stratum], keys, seed, name)


def year_quotas(df: DataFrame, n: int, year: str = "year") -> DataFrame:
    """Equal share per year; the remainder goes to the earliest years. One row per year."""
    years = df.select(year).distinct()
    ordered = years.select(
        year, F.row_number().over(W.orderBy(year)).alias("_i"), F.count(F.lit(1)).over(W.partitionBy()).alias("_k")
    )
    share = F.floor(F.lit(n) / F.col("_k")) + (F.col("_i") <= F.lit(n) % F.col("_k")).cast("int")
    return ordered.select(year, share.cast("long").alias("quota"))


def stratified_sample(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, year: str = "year") -> DataFrame:
    """``n`` rows in equal year quotas; a short year is topped up from rows not picked yet; all rows if n >= N.

    One count per (year, hash bucket) decides everything but two kinds of buckets: where a year's quota ends, and
    where the top-up ends. Only those are ranked; all other rows are kept or dropped by comparing their bucket.
    """
    hashed = df.withColumn("_hash", key_hash(keys, seed)).withColumn("_bucket", hash_bucket(F.col("_hash")))
    counts = hashed.groupBy(year, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # Quotas and cuts have one row per year. Rows without a year are a stratum of their own.
    quotas = year_quotas(counts, n, year).withColumnRenamed(year, "_y")
    running = running_count(counts, [year]).join(quotas, F.col(year).eqNullSafe(F.col("_y"))).drop("_y")
    within = F.least(F.greatest(F.col("quota") - F.col("_before"), F.lit(0)), F.col("_n"))
    cuts = running.groupBy(year).agg(*cut_of(F.col("quota")))

    # Rows left over per bucket, all years together, against the number of rows still missing.
    left = running.withColumn("_taken", within).groupBy("_bucket").agg(
        F.sum(F.col("_n") - F.col("_taken")).alias("_n"), F.sum("_taken").alias("_taken")
    )
    missing = F.greatest(F.lit(n) - F.sum("_taken").over(W.partitionBy()), F.lit(0))
    extra = running_count(left.withColumn("_short", missing)).agg(
        *[c.alias(f"_extra{c_name}") for c, c_name in zip(cut_of(F.col("_short")), ("_cut", "_need"))]
    )
    top = extra.select(F.struct("_extra_cut", "_extra_need")).scalar()
    cuts = cuts.withColumnRenamed(year, "_y")
    marked = hashed.join(cuts, F.col(year).eqNullSafe(F.col("_y"))).drop("_y").withColumns(
        {
            "_edge": F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False)),
            "_in": F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")),
            "_top_in": top.getField("_extra_cut").isNull() | (F.col("_bucket") < top.getField("_extra_cut")),
            "_top_edge": F.coalesce(F.col("_bucket") == top.getField("_extra_cut"), F.lit(False)),
        }
    )
    clear = marked.filter(~F.col("_edge") & ~F.col("_top_edge") & (F.col("_in") | F.col("_top_in")))
    order = ["_hash", *keys]
    close = marked.filter(F.col("_edge") | F.col("_top_edge")).withColumn(
        "_rank", F.row_number().over(W.partitionBy(year, "_edge").orderBy(*order))
    )
    close = close.withColumn("_in", F.when(F.col("_edge"), F.col("_rank") <= F.col("_need")).otherwise(F.col("_in")))
    close = close.withColumn("_rank", F.row_number().over(W.partitionBy("_in", "_top_edge").orderBy(*order)))
    topped = F.when(F.col("_top_edge"), F.col("_rank") <= top.getField("_extra_need")).otherwise(F.col("_top_in"))
    return clear.select(*df.columns).unionByName(close.filter(F.col("_in") | topped).select(*df.columns))


def top_up(picked: DataFrame, pool: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Bring ``picked`` (a stored table) to ``n`` rows with rows of ``pool`` that are not in it, in seeded order."""
    short = F.greatest(F.lit(n) - picked.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    rest = pool.join(picked.select(*keys), list(keys), "left_anti").withColumn("_hash", key_hash(keys, seed))
    extra = take_first(rest, short, ["_hash", *keys], hash_bucket(F.col("_hash"))).drop("_hash")
    return picked.unionByName(extra)


#: Hex digits of the hash that a split compares: all that a double holds exactly.
SPLIT_DIGITS = 13


#: Digits of the hash that a bootstrap draw uses, and the most times a row is drawn for one tree (with chance 1e-17)
_DRAW, _MOST = 12, 18


def bootstrap_limits() -> list[int]:
    """Draws below the k-th limit stand for k or fewer times: the distribution function of a Poisson variable of mean 1."""
    total, term, out = 0.0, exp(-1.0), []
    for k in range(_MOST):
        total += term
        term /= k + 1
        out.append(min(16**_DRAW, round(total * 16**_DRAW)))
    return out


def bootstrap_draw(digest: Column, tree: int | Column, seed: int) -> Column:
    """The digits that decide how often a tree draws a row: hashed from the row's digest, the tree and the seed."""
    return F.substring(key_hash([digest, tree if isinstance(tree, Column) else F.lit(tree)], seed), 1, _DRAW)


def bootstrap_times(draw: str | Column) -> Column:
    """How often a draw (see ``bootstrap_draw``) takes its row: a Poisson count.

    Pass a column, not the hash itself, which would be computed for every limit. Hex digits of one length are ordered as
    their numbers are.
    """
    draw = F.col(draw) if isinstance(draw, str) else draw
    return sum(((draw >= f"{limit:0{_DRAW}x}").cast("int") for limit in bootstrap_limits() if limit < 16**_DRAW), F.lit(0))


def bootstrap_weights(df: DataFrame, keys: Sequence[str], label: str, trees: int, seed: int = 42) -> DataFrame:
    """keys, label, tree, times, weight of every row in every tree that draws it.

    Weights balance the classes inside each tree's own draws: draws / (2 * draws of the class), times the row's count.
    """
    rows = df.select(*keys, label, key_hash(keys, seed).alias("_digest"), F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = rows.withColumn("_draw", bootstrap_draw(F.col("_digest"), F.col("tree"), seed)).drop("_digest")
    drawn = drawn.filter(F.col("_draw") >= f"{bootstrap_limits()[0]:0{_DRAW}x}").withColumn("times", bootstrap_times("_draw")).drop("_draw")
    # One row per tree and class.
    counts = drawn.groupBy("tree", label).agg(F.sum("times").alias("_class"))
    whole = counts.groupBy("tree").agg(F.sum("_class").alias("_all"), F.count(F.lit(1)).alias("_kinds"))
    weights = counts.join(whole, "tree").select("tree", label, (F.col("_all") / (F.col("_kinds") * F.col("_class"))).alias("_each"))
    # Trees and classes bound the weights. Without the hint all draws are dealt out by these few keys before sizes are known.
    return drawn.join(F.broadcast(weights), ["tree", label]).select(*keys, label, "tree", "times", (F.col("_each") * F.col("times")).alias("weight"))


def random_split(
    df: DataFrame, keys: Sequence[str], test_fraction: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Row-level split by key hash: a projection, no shuffle."""
    slots = 16**SPLIT_DIGITS
    slot = hash_slice(key_hash(keys, seed), 1, SPLIT_DIGITS)
    return df.withColumn(name, F.when(slot < int(test_fraction * slots), "test").otherwise("train"))
