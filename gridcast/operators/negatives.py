"""Negative cell-hours: uniform over cells x dates x 24 hours, never a positive key, as many as the positives.

The universe is never built. Draw ``i`` is a pure function of (i, seed): three slices of one digest pick a cell,
a date and an hour. Draws are generated in parallel, joined to the two numbered dimensions, and anti-joined
against the positives; the first ``target`` accepted draws are the sample. Drawing more than needed changes
nothing, so the number of draws is an estimate and not part of the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridcast.functions.hashing import hash_slice
from gridcast.operators.dedupe import dedupe_first
from gridcast.operators.ranking import position, take_first
from gridcast.schemas import CELL_HOUR
from gridcast.session import snapshot

MAX_ATTEMPTS_PER_ROW = 100
#: The sample is cut over this many equal ranges of draw numbers.
DRAW_RANGES = 4096


def numbered_cells(positives: DataFrame) -> DataFrame:
    """Distinct cells numbered from 0 in (y, x) order; counted per grid row, so no task sees all cells."""
    cells = positives.select("cell_y", "cell_x").distinct()
    numbered = position(cells, ["cell_x"], F.col("cell_y"), name="_n")
    return numbered.select((F.col("_n") - 1).cast("long").alias("cell_no"), "cell_y", "cell_x")


def numbered_dates(positives: DataFrame) -> DataFrame:
    dates = positives.select("acq_date").distinct()
    numbered = position(dates, ["acq_date"], F.year("acq_date"), name="_n")
    return numbered.select((F.col("_n") - 1).cast("long").alias("date_no"), "acq_date")


def universe_sizes(positives: DataFrame) -> tuple[int, int, int]:
    """Rows, distinct cells and distinct dates: one row of three numbers comes back to the driver."""
    cells = positives.select("cell_y", "cell_x").distinct().agg(F.count(F.lit(1)).alias("n"))
    dates = positives.select("acq_date").distinct().agg(F.count("acq_date").alias("n"))
    row = positives.agg(F.count(F.lit(1)).alias("rows")).select("rows", cells.scalar().alias("cells"), dates.scalar().alias("dates")).first()
    return row["rows"], row["cells"], row["dates"]


@dataclass(frozen=True)
class Universe:
    """Sizes and numbered cells and dates of a table of positives, stored so that several draws share them."""

    rows: int
    cells: int
    dates: int
    cell_numbers: DataFrame
    date_numbers: DataFrame


def universe_of(positives: DataFrame) -> Universe:
    return Universe(*universe_sizes(positives), snapshot(numbered_cells(positives)), snapshot(numbered_dates(positives)))


def draw_candidates(positives: DataFrame, draws: int, seed: int, cells: int, dates: int, universe: Universe | None = None) -> DataFrame:
    """``draws`` numbered draws from the candidate space (columns: draw, then the four key columns)."""
    spark = positives.sparkSession
    digest = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))
    drawn = spark.range(draws).select(
        F.col("id").alias("draw"),
        (hash_slice(digest, 1, 12) % F.lit(max(cells, 1))).alias("cell_no"),
        (hash_slice(digest, 13, 10) % F.lit(max(dates, 1))).alias("date_no"),
        (hash_slice(digest, 23, 8) % F.lit(24)).cast("int").alias("hour"),
    )
    # No hints: both join keys are uniform, and the runtime picks by measured size.
    return (
        drawn.join(numbered_dates(positives) if universe is None else universe.date_numbers, "date_no")
        .join(numbered_cells(positives) if universe is None else universe.cell_numbers, "cell_no")
        .select("draw", *CELL_HOUR)
    )


def reject_positives(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    return candidates.join(positives.select(*CELL_HOUR).distinct(), list(CELL_HOUR), "left_anti")


def draws_needed(target: int, universe: int, unique: bool = False) -> int:
    """Draws that hold ``target`` acceptable ones beyond reasonable doubt (mean plus eight deviations)."""
    free = universe - target
    if target and free <= 0:
        raise ValueError("Every candidate cell-hour is a positive: no negatives can be drawn")
    if unique and target > free:
        raise ValueError("Fewer candidate cell-hours than distinct negatives asked for")
    share = free / universe if target else 1.0
    mean = target / share
    if unique:
        # Expected draws until ``target`` different ones were seen; all free keys need about ln(free) rounds.
        seen = min(target / free, 1 - 1 / (free + 1))
        mean = free * -math.log1p(-seen) / share
    return min(math.ceil(mean + 8 * math.sqrt(mean) + 64), MAX_ATTEMPTS_PER_ROW * max(target, 1))


def sample_negatives(positives: DataFrame, seed: int = 42, unique: bool = False, universe: Universe | None = None) -> DataFrame:
    """As many negatives as positives. Among themselves they may repeat unless ``unique``.

    ``universe``, from ``universe_of`` the same positives, spares counting and numbering them for every seed.

    ``positives`` has one row per key and is read several times: pass a stored table, not a long plan. One row of
    sizes is fetched to plan the draws, and the accepted draws are stored before they are cut. The result fails when the attempts run out before the target is reached.
    """
    target, cells, dates = universe_sizes(positives) if universe is None else (universe.rows, universe.cells, universe.dates)
    draws = draws_needed(target, cells * dates * 24, unique)
    accepted = reject_positives(draw_candidates(positives, draws, seed, cells, dates, universe), positives)
    if unique:
        accepted = dedupe_first(accepted, CELL_HOUR, ["draw"])
    accepted = snapshot(accepted)
    width = max(1, math.ceil(draws / DRAW_RANGES))
    sample = take_first(
        accepted,
        target,
        ["draw", *CELL_HOUR],
        F.floor(F.col("draw") / width),
        short_message="Unable to draw the requested number of negatives",
    )
    return sample.withColumn("fire", F.lit(0))


def case_control_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Positives and negatives in one table; columns only one side has are NULL on the other."""
    return positives.unionByName(negatives, allowMissingColumns=True)
