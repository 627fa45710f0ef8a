"""Samples, negatives and group splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridcast.catalog.tables import boxed, fire_cells
from gridcast.catalog.views import OBSERVATION_KEYS, Query, Views, oracle, rounded, rounds
from gridcast.operators import holdout, negatives, sampling
from gridcast.plans.experiments import seed_sensitivity
from gridcast.schemas import CELL_HOUR
from gridcast.session import snapshot

SEED = 42
KEYS = ", ".join(OBSERVATION_KEYS)
KEY4 = ", ".join(CELL_HOUR)


def hashed(*keys: str, seed: int | str = SEED) -> str:
    return f"md5(concat_ws('|', {', '.join(keys)}, '{seed}'))"


OBSERVATION_HASH = hashed(*OBSERVATION_KEYS)


def _observation_keys(v: Views):
    return v.observations().select(*OBSERVATION_KEYS, "year")


def _bootstrap(v: Views):
    """Draws and balanced weights of every observation in three trees."""
    o = v.observations().select(*OBSERVATION_KEYS, "fire")
    return rounded(sampling.bootstrap_weights(o, list(OBSERVATION_KEYS), "fire", 3, SEED), "weight")


BOOTSTRAP = f"""
select *, {" + ".join(f"(d >= {limit})::int" for limit in sampling.bootstrap_limits())} as times
from (select {KEYS}, fire, tree::int as tree, ('0x' || substr(md5(concat_ws('|', {hashed(*OBSERVATION_KEYS)}, tree::int, '{SEED}')), 1, 12))::bigint as d
      from observations, (select unnest(generate_series(0, 2)) as tree))
"""


def _stratified(v: Views):
    return sampling.stratified_sample(_observation_keys(v), 1003, list(OBSERVATION_KEYS), SEED)


def _stratified_most(v: Views):
    """Nearly all rows asked for: the last, partial year falls short and the other years top the sample up."""
    o = _observation_keys(v)
    return sampling.stratified_sample(o, o.count() * 95 // 100, list(OBSERVATION_KEYS), SEED)


def _top_up(v: Views):
    """Twenty rows of 2020 brought to 2,000 with rows of any year."""
    o = _observation_keys(v)
    picked = snapshot(sampling.sample_n(o.filter("year = 2020"), 20, list(OBSERVATION_KEYS), SEED))
    return sampling.top_up(picked, o, 2000, list(OBSERVATION_KEYS), SEED)


def _candidates(v: Views):
    positives = snapshot(fire_cells(v).select(*CELL_HOUR))
    rows, cells, dates = negatives.universe_sizes(positives)
    return negatives.draw_candidates(positives, rows, SEED, cells, dates)


def _negatives(v: Views, unique: bool = False):
    return negatives.sample_negatives(snapshot(fire_cells(v).select(*CELL_HOUR)), SEED, unique=unique)


def _reject(v: Views):
    """Cell-hours one hour after a fire that are not fire cells themselves."""
    fires = fire_cells(v).select(*CELL_HOUR)
    later = fires.select("cell_y", "cell_x", "acq_date", ((F.col("hour") + 1) % 24).alias("hour"))
    return negatives.reject_positives(later, fires)


def _spatial(v: Views):
    parts = holdout.spatial_holdout(v.observations(), seed=SEED)
    return parts.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("block").alias("blocks"))


def _membership(v: Views):
    blocked = holdout.with_block(v.observations())
    chosen = holdout.split_blocks(blocked, seed=SEED).filter("split = 'test'")
    inside = holdout.in_blocks(blocked, chosen).withColumn("side", F.lit("in"))
    outside = holdout.in_blocks(blocked, chosen, inside=False).withColumn("side", F.lit("out"))
    return inside.unionByName(outside).select(*OBSERVATION_KEYS, "block", "side")


def hour_score(df):
    """Deterministic stand-in for a model: later hours and northern cells score higher."""
    return df.withColumn("score", F.round((F.col("hour") * 2.0 + F.col("cell_y") % 10) / 60.0, 6))


def _seeds(v: Views):
    positives = snapshot(fire_cells(v).select(*CELL_HOUR, "fire"))
    return rounded(seed_sensitivity(positives, hour_score), "value_mean", "value_std")


def drawn(seed: int, n: str, limit: str) -> str:
    """Draws 0 .. n-1, positives rejected, the first ``limit`` kept."""
    return f"""
    select draw, cell_y, cell_x, acq_date, hour from (
      select id as draw, ('0x' || h[1:12])::bigint % (select count(*) from cell_list) as cell_no,
             ('0x' || h[13:22])::bigint % (select count(*) from date_list) as date_no,
             (('0x' || h[23:30])::bigint % 24)::int as hour
      from (select range as id, md5(concat_ws('|', range, '{seed}')) as h from range({n})))
    join cell_list using (cell_no) join date_list using (date_no)
    {limit}"""


LISTS = {
    "cell_list": "select row_number() over (order by cell_y, cell_x) - 1 as cell_no, * from (select distinct cell_y, cell_x from cells)",
    "date_list": "select row_number() over (order by acq_date) - 1 as date_no, * from (select distinct acq_date from cells)",
}
TARGET = "(select count(*) from cells)"
#: Enough draws for any share of positives in the given tables; drawing more changes nothing.
DRAWS = f"(4 * {TARGET} + 1000)"
REJECTED = f"""where ({KEY4}) not in (select ({KEY4}) from cells) order by draw limit {TARGET}"""

HASH_CUT = f"""
select {KEYS}, year, row_number() over (partition by year order by {OBSERVATION_HASH}, {KEYS}) as r, {OBSERVATION_HASH} as h
from observations
"""


def stratified(n: str) -> str:
    return f"""
    select {KEYS}, year from (
      select o.*, (o.r > q.quota)::int as over from ranked o join (
        select year, {n} // k + (i <= {n} % k)::int as quota
        from (select year, row_number() over (order by year) as i, count(*) over () as k
              from (select distinct year from observations))) q using (year))
    order by over, h, {KEYS} limit {n}"""


def _seed_metrics(seed: int) -> str:
    return f"""
    select {seed} as seed, * from (
      select score, count(*) as n, sum(fire)::bigint as tp from (
        select round((hour * 2.0::double + cell_y % 10) / 60.0::double, 6) as score, fire from (
          select cell_y, hour, 1 as fire from cells union all select cell_y, hour, 0 as fire from draws_{seed}))
      group by score)"""


SEED_TABLE = """
select seed, n, tp, sum(n) over w as cn, sum(tp) over w as ctp, sum(tp) over (partition by seed) as p,
       sum(n) over (partition by seed) as total
from (from seed_41 union all from seed_42 union all from seed_43)
window w as (partition by seed order by score desc)
"""
SEED_SCORES = """
select seed, (sum((n - tp) * ((ctp - tp)::double + tp / 2.0::double)) / (max(p)::double * max(total - p))) as roc_auc,
       (sum(tp::double * ctp / cn) / max(p)::double) as pr_auc
from seed_table group by seed
"""

QUERIES = {
    "sample_n": Query(
        lambda v: sampling.sample_n(boxed(v).select("det_id", *CELL_HOUR, "frp"), 5000, ["det_id"], SEED),
        oracle(f"select det_id, {KEY4}, frp from boxed order by {hashed('det_id')}, det_id limit 5000", "boxed"),
    ),
    "shuffle_rows": Query(
        lambda v: sampling.shuffle_rows(boxed(v).select("det_id", "frp"), ["det_id"], SEED),
        oracle(f"select det_id, frp, row_number() over (order by {hashed('det_id')}, det_id) as position from boxed", "boxed"),
    ),
    "year_rank": Query(
        lambda v: sampling.rank_in_stratum(_observation_keys(v), "year", list(OBSERVATION_KEYS), SEED),
        oracle(f"select {KEYS}, year, r as rank from ranked", "observations", ranked=HASH_CUT),
    ),
    "bootstrap_weights": Query(
        _bootstrap,
        oracle(
            f"""select {KEYS}, fire, tree, times::int as times, {rounds('weight')} from
                (select *, times * (sum(times) over (partition by tree))::double
                        / ((count(distinct fire) over (partition by tree)) * sum(times) over (partition by tree, fire)) as weight
                 from drawn where times > 0)""",
            "observations",
            drawn=BOOTSTRAP,
        ),
    ),
    "stratified_sample": Query(_stratified, oracle(stratified("1003"), "observations", ranked=HASH_CUT)),
    "stratified_sample_topped_up": Query(
        _stratified_most,
        oracle(stratified("(select count(*) * 95 // 100 from observations)"), "observations", ranked=HASH_CUT),
    ),
    "top_up_sample": Query(
        _top_up,
        oracle(
            f"""from (select {KEYS}, year from ranked where year = 2020 and r <= 20)
                union all
                (select {KEYS}, year from ranked where not (year = 2020 and r <= 20) order by h, {KEYS} limit 1980)""",
            "observations",
            ranked=HASH_CUT,
        ),
    ),
    "reject_positives": Query(
        _reject,
        oracle(
            f"""select * from (select cell_y, cell_x, acq_date, ((hour + 1) % 24)::int as hour from cells)
                where ({KEY4}) not in (select ({KEY4}) from cells)""",
            "cells",
        ),
    ),
    "negative_candidates": Query(
        _candidates, oracle("from candidates", "cells", **LISTS, candidates=drawn(SEED, TARGET, ""))
    ),
    "sample_negatives": Query(
        _negatives, oracle("select *, 0 as fire from negatives", "cells", **LISTS, negatives=drawn(SEED, DRAWS, REJECTED))
    ),
    "sample_negatives_distinct": Query(
        lambda v: _negatives(v, unique=True),
        oracle(
            f"""select *, 0 as fire from (select min(draw) as draw, {KEY4} from draws group by {KEY4})
                order by draw limit {TARGET}""",
            "cells",
            **LISTS,
            draws=drawn(SEED, f"(20 * {TARGET} + 1000)", f"where ({KEY4}) not in (select ({KEY4}) from cells)"),
        ),
    ),
    "spatial_holdout": Query(
        _spatial,
        oracle(
            """select split, count(*) as rows, count(distinct block) as blocks
               from blocked join sides using (block) group by split""",
            "blocked",
            sides=f"""select block, case when row_number() over (order by {hashed('block')}, block)
                        <= greatest(1, round_even(0.2::double * count(*) over (), 0)) then 'test' else 'train' end as split
                      from (select distinct block from blocked)""",
        ),
    ),
    "block_membership": Query(
        _membership,
        oracle(
            f"select {KEYS}, block, case split when 'test' then 'in' else 'out' end as side from blocked join sides using (block)",
            "blocked",
            sides=f"""select block, case when row_number() over (order by {hashed('block')}, block)
                        <= greatest(1, round_even(0.2::double * count(*) over (), 0)) then 'test' else 'train' end as split
                      from (select distinct block from blocked)""",
        ),
    ),
    "random_split": Query(
        lambda v: sampling.random_split(_observation_keys(v), list(OBSERVATION_KEYS), 0.2, SEED),
        oracle(
            f"""select {KEYS}, year, case when ('0x' || {OBSERVATION_HASH}[1:4])::bigint < 13107 then 'test' else 'train' end
                  as split from observations""",
            "observations",
        ),
    ),
    "seed_sensitivity": Query(
        _seeds,
        oracle(
            f"select metric, {rounds('value_mean', 'value_std')}, repeats from summary",
            "cells",
            **LISTS,
            **{f"draws_{s}": drawn(s, DRAWS, REJECTED) for s in (41, 42, 43)},
            **{f"seed_{s}": _seed_metrics(s) for s in (41, 42, 43)},
            seed_table=SEED_TABLE,
            seed_scores=SEED_SCORES,
            summary=" union all ".join(
                f"""select '{m}' as metric, avg({m}) as value_mean, stddev_pop({m}) as value_std, count({m}) as repeats
                    from seed_scores"""
                for m in ("roc_auc", "pr_auc")
            ),
        ),
    ),
}
