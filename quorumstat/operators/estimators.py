"""Cross-sectional and panel estimators over one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import DEFAULT_POLICY, Design, Item, Policy, finalize, grid, prefix_sums, records


def means(frame: DataFrame, items: list[Item], design: Design, by=(), policy: Policy = DEFAULT_POLICY, stat: str = "mean", ci_level: float = 0.95, share: bool = False) -> DataFrame:
    by = list(by)
    keys = [*by, *[k for k, _ in items[0].keys]]
    all_rows = grid(frame, by, [i.keys for i in items]) if keys and not by else None  # an empty frame, too, has its items
    return finalize(records(frame, items, design, by), keys, stat, design, policy, ci_level, True, share, all_rows)


def weighted_mean(frame: DataFrame, value: str, design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY, ci_level: float = 0.95) -> DataFrame:
    return means(frame, [Item(F.col(value))], design, by, policy, "mean", ci_level)


def kish_n_eff(frame: DataFrame, weight: str = "w", by=()) -> DataFrame:
    """(by, n, sum_w, n_eff); a weight that is not positive is an error of the job."""
    w = F.when(F.col(weight) > 0, F.col(weight)).otherwise(F.raise_error(F.lit("weights must be positive")).cast("double"))
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sum_w"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"))


#: Levels are conditional sums of one aggregation; an item with more answers is no categorical one.
MAX_LEVELS = 1000


def observed_levels(frame: DataFrame, value: str) -> list[int]:
    """The distinct codes of a categorical item; more than MAX_LEVELS are an error."""
    found = frame.where(F.col(value).isNotNull()).select(value).distinct().limit(MAX_LEVELS + 1).collect()
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{value} has more than {MAX_LEVELS} distinct values; give its levels or bin it")
    return sorted(r[0] for r in found)


def indicator(value: Column, level) -> Column:
    return F.when(value.isNotNull(), (value == F.lit(level)).cast("double"))


def weighted_proportion(frame: DataFrame, value: str, design: Design = Design(), by=(), levels: list | None = None, policy: Policy = DEFAULT_POLICY, stat: str = "proportion") -> DataFrame:
    levels = observed_levels(frame, value) if levels is None else levels
    if len(set(levels)) != len(levels):
        raise ValueError("levels must be distinct")
    return means(frame, [Item(indicator(F.col(value), x), (("level", x),)) for x in levels], design, by, policy, stat, share=True)


def weighted_distribution(frame: DataFrame, value: str, design: Design = Design(), by=(), levels: list | None = None, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Histogram over the contiguous observed range; empty bins stay."""
    if levels is None:
        lo, hi = frame.agg(F.min(value), F.max(value)).first()
        if lo is not None and hi - lo >= MAX_LEVELS:
            raise ValueError(f"{value} spans {lo} to {hi}, more than {MAX_LEVELS} bins; give its levels or bin it")
        levels = list(range(lo, hi + 1)) if lo is not None else []
    return weighted_proportion(frame, value, design, by, levels, policy, "distribution")


def weighted_quantile(frame: DataFrame, value: str, design: Design = Design(), p=(0.5,), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Smallest value whose weighted distribution function reaches p; rows are first summed by value, values by ranges."""
    if not p or not all(0 < q < 1 for q in p):
        raise ValueError(f"p must lie within (0, 1), got {p!r}")
    by = list(by)
    sums = frame.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.sum(design.weight).cast("double").alias("sw"), F.count("*").alias("c"))
    cdf = prefix_sums(sums, by, "_v", {"upto": "sw"}).withColumn("cdf", F.col("upto") / F.col("upto_all"))
    wide = cdf.groupBy(*by).agg(F.sum("c").alias("n"), F.sum("sw").alias("sum_w"), *[F.min(F.when(F.col("cdf") >= q, F.col("_v"))).alias(f"q{i}") for i, q in enumerate(p)])
    none = F.lit(None)
    recs = wide.select(*by, "n", "sum_w", F.inline(F.array(*[F.struct(F.lit(float(q)).alias("p"), F.col(f"q{i}").alias("estimate")) for i, q in enumerate(p)]))).withColumns(
        {"one": F.lit(0), "se": none.cast("double"), "n_psu": none.cast("long"), "n_strata": none.cast("long"), "df": none.cast("long")}
    )
    return finalize(recs, [*by, "p"], "quantile", design, policy, intervals=False, all_rows=grid(frame, by, [(("p", float(q)),) for q in p]))


# --- panel


def paired_change(frame: DataFrame, earlier: str, later: str, design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    return means(frame, [Item(F.col(later).cast("double") - F.col(earlier))], design, by, policy, "change")


def both_there(earlier: str, later: str) -> Column:
    return F.col(earlier).isNotNull() & F.col(later).isNotNull()


def paired_share_change(frame: DataFrame, earlier: str, later: str, levels: list, design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    items = [Item(F.when(both_there(earlier, later), (F.col(later) == x).cast("double") - (F.col(earlier) == x).cast("double")), (("level", x),)) for x in levels]
    return means(frame, items, design, by, policy, "share_change")


def change_distribution(frame: DataFrame, earlier: str, later: str, span: int, design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    diff = F.col(later).cast("int") - F.col(earlier).cast("int")
    items = [Item(indicator(diff, x), (("level", x),)) for x in range(-span, span + 1)]
    return means(frame, items, design, by, policy, "change_distribution", share=True)


def three_point_panel(frame: DataFrame, y1: str, my: str, y2: str, design: Design = Design(), by=(), midyear_type: str = "midyear_type", policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Three legs on one weight; midyear to second wave only where the midyear interview stood alone, as a domain."""
    c = lambda x: F.col(x).cast("double")
    legs = [("y1_my", c(my) - c(y1), None), ("my_y2", c(y2) - c(my), F.col(midyear_type) == 1), ("y1_y2", c(y2) - c(y1), None)]
    return means(frame, [Item(v, (("leg", k),), d) for k, v, d in legs], design, by, policy, "change")


def transition_joint(frame: DataFrame, earlier: str, later: str, levels: list[int], design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    both = both_there(earlier, later)
    items = [
        Item(F.when(both, ((F.col(earlier) == i) & (F.col(later) == j)).cast("double")), (("from_level", i), ("to_level", j), ("measure", "joint"))) for i in levels for j in levels
    ]
    return means(frame, items, design, by, policy, "transition", share=True)


def transition_conditional(frame: DataFrame, earlier: str, later: str, levels: list[int], design: Design = Design(), by=(), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """P(later | earlier): the share within the domain of those who were at the earlier level."""
    both = both_there(earlier, later)
    items = [
        Item(F.when(both & (F.col(earlier) == i), (F.col(later) == j).cast("double")), (("from_level", i), ("to_level", j), ("measure", "conditional"))) for i in levels for j in levels
    ]
    return means(frame, items, design, by, policy, "transition", share=True)


# --- averages over countries and orderings


def average_countries(estimates: DataFrame, keys: list[str], country: str = "country_code", ci_level: float = 0.95) -> DataFrame:
    """Plain mean of the countries' estimates; its error needs every country's."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf((1 + ci_level) / 2)
    e = estimates.where("estimate is not null")
    k = F.count("*")
    out = e.groupBy(*keys).agg(
        F.avg("estimate").alias("estimate"), F.when(F.count("se") == k, F.sqrt(F.sum(F.col("se") * F.col("se"))) / k).alias("se"), F.sum("n").alias("n"), F.sum("sum_w").alias("sum_w"),
        k.alias("n_countries"), F.max("n").alias("largest_n"), F.sort_array(F.collect_list(country)).alias("countries"),
    )
    spread = F.col("se") > 1e-9
    return out.withColumns({"ci_lo": F.when(spread, F.col("estimate") - z * F.col("se")), "ci_hi": F.when(spread, F.col("estimate") + z * F.col("se"))})


def coverage_floor(averaged: DataFrame, n_countries: int) -> DataFrame:
    """Averages over at least half of the countries, rounded up."""
    return averaged.where(F.col("n_countries") >= (n_countries + 1) // 2)


def order_by_value(df: DataFrame, name: str, value: str = "estimate", ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value), name)


def order_by_gap(cells: DataFrame, group: str, thin: str = "flagged") -> DataFrame:
    """Groups by the range of their non-thin cells, widest first; groups with fewer than two such cells last."""
    solid = F.when(~F.col(thin), F.col("estimate"))
    g = cells.groupBy(group).agg(F.when(F.count(solid) >= 2, F.max(solid) - F.min(solid)).alias("gap"))
    return g.orderBy(F.desc_nulls_last("gap"), group)


def order_change_legs(legs: DataFrame, group: str, leg: str) -> DataFrame:
    """Rows with `place`: the rank of their group by one leg's estimate, nulls last; legs of a group stay together."""
    first = legs.where(F.col("leg") == leg).groupBy(group).agg(F.max("estimate").alias("by_leg"))
    placed = first.select(F.col(group).alias("_g"), F.row_number().over(W.orderBy(F.desc_nulls_last("by_leg"), group)).alias("place"))  # a row for each country
    return legs.join(placed, F.col(group) == F.col("_g"), "left").drop("_g").orderBy("place", "leg")


def rank_items(rows: DataFrame, item: str = "item", within: str = "country_code") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(within).orderBy(F.desc_nulls_last("estimate"), item)))


def equal_count_steps(rows: DataFrame, value: str = "estimate", steps: int = 7) -> DataFrame:
    """Shade by mid-rank; ties share a shade.  One row is a group of the result table."""
    v = rows.where(F.col(value).isNotNull())
    counts = v.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("c"))
    run = W.orderBy("_v")
    ranked = counts.withColumns({"before": F.sum("c").over(run) - F.col("c"), "all": F.sum("c").over(W.partitionBy(F.lit(1)))})
    step = F.least(F.floor((F.col("before") + (F.col("c") - 1) / 2 + 0.5) / F.col("all") * steps), F.lit(steps - 1)).cast("int")
    return rows.join(ranked.select("_v", step.alias("step")), F.col(value) == F.col("_v"), "left").drop("_v")


def equal_width_steps(rows: DataFrame, value: str = "estimate", steps: int = 7) -> DataFrame:
    lo_hi = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * steps), F.lit(steps - 1))).otherwise(F.lit(0)).cast("int")
    return rows.crossJoin(F.broadcast(lo_hi)).withColumn("step", F.when(F.col(value).isNotNull(), step)).drop("_lo", "_hi")  # one row


def extremes(rows: DataFrame, name: str, value: str = "estimate") -> DataFrame:
    v = rows.where(F.col(value).isNotNull())
    top, low = F.max(F.struct(F.col(value), F.col(name))), F.min(F.struct(F.col(value), F.col(name)))
    return v.agg(top[name].alias("highest"), top[value].alias("highest_value"), low[name].alias("lowest"), low[value].alias("lowest_value"))


def order_by_level(rows: DataFrame, order: list, level: str = "level") -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    return rows.where(place > 0).withColumn("place", place.cast("int")).orderBy("place")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
