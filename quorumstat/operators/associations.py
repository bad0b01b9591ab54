"""Correlations, sweeps, cross-tabs and adjusted regressions."""

from __future__ import annotations

import sys
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .core import NO_SUPPRESSION, SERVING_POLICY, Design, Item, Policy, _variance, design_counts, finalize, grid, kept, match, prefix_sums, rewritten, small_side, suppress_small_cells, taylor_variance
from .estimators import all_of, indicator, means, observed_levels, weighted_quantile

# Functions sent to Python workers carry their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__package__])


def _moments(w: str, x: str, y: str) -> list:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    c = lambda e: F.when(both, e)
    vx, vy, vw = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w).cast("double")
    return [
        F.sum(c(vw)).alias("sw"), F.sum(c(vw * vx)).alias("sx"), F.sum(c(vw * vy)).alias("sy"), F.sum(c(vw * vx * vx)).alias("sxx"), F.sum(c(vw * vy * vy)).alias("syy"),
        F.sum(c(vw * vx * vy)).alias("sxy"), F.sum(c(F.lit(1))).alias("n"), (F.max(c(vx)) != F.min(c(vx))).alias("vx"), (F.max(c(vy)) != F.min(c(vy))).alias("vy"),
    ]


def _coefficient(prefix: str = "") -> F.Column:
    c = lambda n: F.col(f"{prefix}{n}")
    cov, a, b = c("sxy") - c("sx") * c("sy") / c("sw"), c("sxx") - c("sx") * c("sx") / c("sw"), c("syy") - c("sy") * c("sy") / c("sw")
    return F.when((c("n") >= 2) & c("vx") & c("vy") & (a > 0) & (b > 0), cov / F.sqrt(a * b))


def weighted_correlations(frame: DataFrame, x: str, ys: list[str], design: Design = Design(), by=(), policy: Policy = NO_SUPPRESSION) -> DataFrame:
    """Pearson r of x with each of ys on their complete cases, all in one aggregation; null unless both items vary."""
    wide = frame.groupBy(*by).agg(*[F.struct(*_moments(design.weight, x, y)).alias(f"m{i}") for i, y in enumerate(ys)])
    long = wide.select(*by, F.inline(F.array(*[F.struct(F.lit(y).alias("predictor"), F.col(f"m{i}").alias("m")) for i, y in enumerate(ys)])))
    out = long.select(*by, "predictor", _coefficient("m.").alias("estimate"), F.coalesce("m.n", F.lit(0)).cast("long").alias("n"), F.coalesce("m.sw", F.lit(0.0)).alias("sum_w"))
    return suppress_small_cells(out, policy, columns=("estimate",))


def weighted_pearson(frame: DataFrame, x: str, y: str, design: Design = Design(), by=(), policy: Policy = NO_SUPPRESSION) -> DataFrame:
    return weighted_correlations(frame, x, [y], design, by, policy)


def pair_contingency(frame: DataFrame, x: str, y: str, weight: str, by=()) -> DataFrame:
    """(by, vx, vy, n, sw): answers are few, so this is small, and it holds ranks, moments and cross-tabs alike."""
    both = frame.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*by, F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")).agg(F.count("*").alias("n"), F.sum(weight).cast("double").alias("sw"))


def spearman_from_contingency(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted Pearson of unweighted average ranks, from value counts and not from a sort of the rows.  The cells of a
    group are ranked in one task: for answers of few values; `weighted_spearman` ranks any number of them."""

    def rank(v: str) -> F.Column:
        group = [F.col(k) for k in keys] or [F.lit(1)]
        c = F.sum("n").over(W.partitionBy(*group, v))
        return F.sum("n").over(W.partitionBy(*group).orderBy(v).rangeBetween(W.unboundedPreceding, W.currentRow)) - c + (c + 1) / 2

    return _rank_correlation(cells.withColumns({"rx": rank("vx"), "ry": rank("vy")}), keys)


def _rank_correlation(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, estimate, n, sum_w) from cells with ranks rx and ry."""
    s = lambda e, a: F.sum(F.col("sw") * e).alias(a)
    rx, ry = F.col("rx"), F.col("ry")
    m = ranked.groupBy(*keys).agg(
        F.sum("sw").alias("sw"), s(rx, "sx"), s(ry, "sy"), s(rx * rx, "sxx"), s(ry * ry, "syy"), s(rx * ry, "sxy"), F.sum("n").alias("n"), (F.max(rx) != F.min(rx)).alias("vx"), (F.max(ry) != F.min(ry)).alias("vy")
    )
    return m.select(*keys, _coefficient().alias("estimate"), "n", F.col("sw").alias("sum_w"))


def weighted_spearman(frame: DataFrame, x: str, y: str, design: Design = Design(), by=()) -> DataFrame:
    """Spearman's coefficient of continuous or coded values: ranks come from prefix sums over ranges of values, so that no
    task holds all values of a group."""
    by = list(by)
    cells = kept(pair_contingency(frame, x, y, design.weight, by))
    for v, name in (("vx", "rx"), ("vy", "ry")):
        counts = cells.groupBy(*by, v).agg(F.sum("n").alias("c"))
        ranks = prefix_sums(counts, by, v, {"upto": "c"}).withColumn(name, F.col("upto") - F.col("c") + (F.col("c") + 1) / 2)
        cells = match(cells, ranks.select(*by, v, name), [*by, v], null_safe=True)
    return _rank_correlation(cells, by)


def correlation_matrix(frame: DataFrame, items: list[str], design: Design = Design(), by=(), min_n: int = 100, shared: frozenset = frozenset()) -> DataFrame:
    """Every pair of 2-10 items; pairs built from the same answers are marked."""
    if not 2 <= len(items) <= 10:
        raise ValueError("a matrix takes 2 to 10 items")
    pairs = list(combinations(items, 2))
    wide = frame.groupBy(*by).agg(*[F.struct(*_moments(design.weight, a, b)).alias(f"m{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(frozenset((a, b)) in shared).alias("shares_answers"), F.col(f"m{i}").alias("m")) for i, (a, b) in enumerate(pairs)]
    long = wide.select(*by, F.inline(F.array(*rows)))
    n = F.coalesce("m.n", F.lit(0)).cast("long")
    return long.select(*by, "a", "b", "shares_answers", _coefficient("m.").alias("estimate"), n.alias("n"), (n < min_n).alias("below_min_n"))


def pair_lookup(table: DataFrame, x: str, ys: list[str], policy: Policy = SERVING_POLICY) -> DataFrame:
    """Rows of the materialised pair table for x with ys, in either orientation, with the policy applied on reading."""
    one = table.where((F.col("a") == x) & F.col("b").isin(ys)).withColumn("predictor", F.col("b"))
    two = table.where((F.col("b") == x) & F.col("a").isin(ys)).withColumn("predictor", F.col("a"))
    return suppress_small_cells(one.unionByName(two).drop("a", "b"), policy, columns=("estimate",))


def ranked_correlates(estimates: DataFrame, by: list[str], min_n: int = 100, limit: int = 20) -> DataFrame:
    """Predictors by median |estimate| over groups with enough rows, ties by name; `limit` is the report's length."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie within 1 and 200")
    strong = estimates.where(F.col("estimate").isNotNull() & (F.col("n") >= min_n))
    g = strong.groupBy("predictor").agg(F.median(F.abs("estimate")).alias("strength"), F.count("*").alias("n_groups"))
    return g.withColumn("rank", F.row_number().over(W.orderBy(F.desc("strength"), "predictor"))).where(F.col("rank") <= limit)  # a row for each predictor


def drop_overlaps(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """`ranked(predictor, rank, n_answers, is_binary, components)`, ranks distinct, with kept_instead: what stays in place of
    a predictor that shares answers with it; null for those that stay.  With `limit`, only those that a walk down the
    ranks passes until so many are kept; what ranks below displaces nothing.

    The walk takes a predictor unless it shares answers with one in the list; it replaces all of those if it stands in for
    each (more answers, or as many and not binary like the other), and is left out else.  What it finds depends only on
    predictors of better rank that share answers with it, and on those that share answers with them.  So each round
    decides at once every predictor none of these of which is still open, until all are decided.
    """
    ranked = rewritten(ranked)  # read once here and in each round below, computed once
    facts = ranked.select("predictor", "rank", "n_answers", "is_binary")
    parts = ranked.select("predictor", F.explode(F.array_distinct("components")).alias("part"))
    met = parts.join(parts.withColumnRenamed("predictor", "other"), "part").where("predictor <> other").select("predictor", "other").distinct()
    side = lambda p: facts.select(*[F.col(c).alias(f"{p}_{c}") for c in facts.columns])
    both = met.join(side("v"), F.col("predictor") == F.col("v_predictor")).join(side("u"), F.col("other") == F.col("u_predictor"))
    stands_in = F.when(F.col("v_n_answers") != F.col("u_n_answers"), F.col("v_n_answers") > F.col("u_n_answers")).otherwise(~F.col("v_is_binary") & F.col("u_is_binary"))
    met = rewritten(both.select(F.col("predictor").alias("v"), F.col("v_rank").alias("rv"), F.col("other").alias("u"), F.col("u_rank").alias("ru"), stands_in.alias("wins")))
    above = met.where("ru < rv")
    # (v, u, w): w met u between u and v
    between = rewritten(above.select("v", "rv", "u", "ru").join(met.select(F.col("v").alias("u"), F.col("u").alias("w"), F.col("ru").alias("rw")), "u").where("ru < rw and rw < rv").select("v", "u", "w"))
    state = rewritten(facts.select("predictor", "rank", F.lit(None).cast("boolean").alias("entered")))
    while True:
        undecided = state.where("entered is null").select("predictor")
        if not undecided.limit(1).count():
            break
        waits = above.select("v", F.col("u").alias("on")).unionByName(between.select("v", F.col("w").alias("on"))).join(undecided.withColumnRenamed("predictor", "on"), "on").select(F.col("v").alias("predictor"))
        ready = undecided.join(waits, "predictor", "left_anti")
        loses = _in_list(above, between, state).where("not wins").select(F.col("v").alias("predictor")).distinct().withColumn("_loses", F.lit(True))
        fresh = ready.join(loses, "predictor", "left").select("predictor", F.col("_loses").isNull().alias("_fresh"))
        state = rewritten(state.join(fresh, "predictor", "left").select("predictor", "rank", F.coalesce("entered", "_fresh").alias("entered")))
    entered = state.where("entered").select(F.col("predictor").alias("w"))
    replaced = met.where("ru > rv").join(entered, F.col("u") == F.col("w")).groupBy("v").agg(F.min("ru").alias("until"), F.min_by("u", "ru").alias("by"))
    fates = state.join(replaced, (F.col("predictor") == F.col("v")) & F.col("entered"), "left").drop("v")
    rival = _in_list(above, between, state).where("not wins").groupBy("v").agg(F.min_by("u", "ru").alias("rival"))
    fates = rewritten(fates.join(rival, (F.col("predictor") == F.col("v")) & ~F.col("entered"), "left").drop("v"))
    if limit is not None:
        steps = fates.where("entered").select(F.col("rank").alias("at"), F.lit(1).alias("d")).unionByName(fates.where("until is not null").select(F.col("until").alias("at"), F.lit(-1).alias("d")))
        held = steps.groupBy("at").agg(F.sum("d").alias("d")).withColumn("held", F.sum("d").over(W.orderBy("at")))  # a row for each predictor
        last = held.where(F.col("held") >= limit).agg(F.min("at").alias("last"))
        fates = fates.join(F.broadcast(last), F.lit(True)).where(F.col("last").isNull() | (F.col("rank") <= F.col("last")))  # one row
        gone = (F.col("until") > F.col("last")) & F.col("last").isNotNull()
        fates = rewritten(fates.withColumns({"by": F.when(~gone, F.col("by"))}))
    heir = rewritten(fates.select("predictor", F.coalesce("by", "rival").alias("heir")))
    while True:  # what stands in for a predictor may have been replaced itself
        next_heir = heir.select(F.col("predictor").alias("heir"), F.col("heir").alias("later"))
        further = heir.join(next_heir, "heir", "left").select("predictor", F.coalesce("later", "heir").alias("new"), F.col("later").isNotNull().alias("moved"))
        further = rewritten(further)
        heir = further.select("predictor", F.col("new").alias("heir"))
        if not further.where("moved").limit(1).count():
            break
    return ranked.join(heir.select("predictor", F.col("heir").alias("kept_instead")), "predictor")


def _in_list(above: DataFrame, between: DataFrame, state: DataFrame) -> DataFrame:
    """The rows of `above(v, u)` whose u is in the list when v is reached: entered, and not replaced by one that met it and
    entered before v."""
    entered = state.where("entered").select(F.col("predictor").alias("e"))
    here = above.join(entered, F.col("u") == F.col("e")).drop("e")
    gone = between.join(entered, F.col("w") == F.col("e")).select("v", "u").distinct()
    return here.join(gone, ["v", "u"], "left_anti")


def cross_tab(frame: DataFrame, x: str, y: str, design: Design = Design(), x_levels: list | None = None, y_levels: list | None = None, policy: Policy = SERVING_POLICY, column_flag: int = 100) -> DataFrame:
    """Shares of y within each answer x, with the share of x itself and the correlation of the two items; cells without
    rows stay with n = 0.

    The frame is summed once by both answers and sampling unit.  Shares of both kinds with their errors, the design's
    counts and the moments of the correlation all come from that table.  Without a design, shares are estimated from
    the rows.
    """
    x_levels = x_levels or observed_levels(frame, x)
    y_levels = y_levels or observed_levels(frame, y)
    keys = ["x", "y", "of"]
    items = [(i, j, "cell") for i in x_levels for j in y_levels] + [(i, y_levels[0], "column") for i in x_levels]
    if design.strata is None:
        vx, vy = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a)) for a, b in ((x, y), (y, x)))
        shares = [Item(indicator(vy, j) if of == "cell" else indicator(vx, i), (("x", i), ("y", j), ("of", of)), vx == i if of == "cell" else None) for i, j, of in items]
        every = kept(means(frame, shares, design, (), policy, "proportion", share=True))
        moments = frame.agg(*_moments(design.weight, x, y))
    else:
        w = F.col(design.weight).cast("double")
        sums = kept(frame.groupBy(F.col(x).alias("vx"), F.col(y).alias("vy"), F.col(design.strata).alias("_strata"), F.col(design.psu).alias("_psu")).agg(F.sum(w).alias("sw"), F.count("*").alias("n")))
        both = sums.where("vx is not null and vy is not null")
        recs = _share_records(both, unit_counts_of(sums), x_levels, y_levels)
        every = kept(finalize(recs, keys, "proportion", design, policy, share=True, all_rows=grid(frame, [], [tuple(zip(keys, i, strict=True)) for i in items])))
        pairs = both.groupBy("vx", "vy").agg(F.sum("sw").alias("sw"), F.sum("n").alias("n"))
        vx, vy, s = F.col("vx").cast("double"), F.col("vy").cast("double"), lambda e: F.sum(F.col("sw") * e)
        moments = pairs.agg(
            F.sum("sw").alias("sw"), s(vx).alias("sx"), s(vy).alias("sy"), s(vx * vx).alias("sxx"), s(vy * vy).alias("syy"), s(vx * vy).alias("sxy"), F.sum("n").alias("n"),
            (F.max("vx") != F.min("vx")).alias("vx"), (F.max("vy") != F.min("vy")).alias("vy"),
        )
    columns = every.where("of = 'column'").select("x", F.col("estimate").alias("column_share"), F.col("se").alias("column_se"), F.col("n").alias("column_n"))
    out = match(every.where("of = 'cell'").select("x", "y", "estimate", "se", "n"), columns, ["x"], "left")
    out = match(out, moments.select(_coefficient().alias("correlation"), F.coalesce("n", F.lit(0)).alias("pairs")), [])
    return out.withColumns({"thin_cell": F.col("n") < policy.flag_below, "thin_column": F.col("column_n") < column_flag})


def unit_counts_of(sums: DataFrame) -> DataFrame:
    """(_strata, nh): sampling units of each stratum of a table that holds every unit of the frame."""
    return sums.groupBy("_strata").agg(F.countDistinct("_psu").alias("nh"))


def _share_records(cells: DataFrame, counts: DataFrame, x_levels: list, y_levels: list) -> DataFrame:
    """Records of the shares of y within x, and of x among all, from `cells(vx, vy, _strata, _psu, sw, n)`.

    A unit's score is (a - p b) / W for its weight a at the level and b in the domain.  The sums of scores and of their
    squares by stratum follow from those of a, b, aa, ab and bb, and units without anybody at the level add to b and bb
    only, so no row is made for them.
    """
    keys = ["x", "y", "of"]
    in_x, in_all = W.partitionBy("vx", "_strata", "_psu"), W.partitionBy("_strata", "_psu")
    placed = cells.withColumns({"bx": F.sum("sw").over(in_x)})
    units_x = kept(cells.groupBy("vx", "_strata", "_psu").agg(F.sum("sw").alias("a"), F.sum("n").alias("n")).withColumns({"b": F.sum("a").over(in_all), "nb": F.sum("n").over(in_all)}))
    level = lambda a, b: [F.sum(F.col(a) * F.col(a)).alias("aa"), F.sum(F.col(a) * F.col(b)).alias("ab"), F.sum(a).alias("a"), F.sum("n").alias("one")]
    domain = lambda b: [F.sum(F.col(b) * F.col(b)).alias("bb"), F.sum(b).alias("b"), F.count("*").alias("seen"), F.sum("n").alias("n")]
    each = lambda levels: F.explode(F.array(*map(F.lit, levels)))
    of_cell = units_x.groupBy(F.col("vx").alias("x"), "_strata").agg(*domain("a")).select("x", "_strata", "bb", "b", "seen", "n", each(y_levels).alias("y"))
    of_cell = match(of_cell, placed.groupBy(F.col("vx").alias("x"), F.col("vy").alias("y"), "_strata").agg(*level("sw", "bx")), ["x", "y", "_strata"], "left").withColumn("of", F.lit("cell"))
    whole = units_x.groupBy("_strata", "_psu").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    of_column = whole.groupBy("_strata").agg(*domain("a")).select("_strata", "bb", "b", "seen", "n", each(x_levels).alias("x"))
    of_column = match(of_column, units_x.groupBy(F.col("vx").alias("x"), "_strata").agg(*level("a", "b")), ["x", "_strata"], "left").withColumns({"of": F.lit("column"), "y": F.lit(y_levels[0])})
    strata = of_cell.select(*keys, "_strata", "aa", "ab", "a", "bb", "b", "seen", "n", "one").unionByName(of_column.select(*keys, "_strata", "aa", "ab", "a", "bb", "b", "seen", "n", "one"))
    strata = strata.fillna(0, ["aa", "ab", "a", "one"])
    group = W.partitionBy(*keys)
    total = {f"all_{c}": F.sum(c).over(group) for c in ("a", "b", "n", "one")}
    p, w = F.col("all_a") / F.col("all_b"), F.col("all_b")
    scored = kept(strata.withColumns(total).withColumns({"p": p, "squares": (F.col("aa") - 2 * p * F.col("ab") + p * p * F.col("bb")) / (w * w), "score": (F.col("a") - p * F.col("b")) / w}))
    g = scored.groupBy(*keys).agg(F.max("p").alias("estimate"), F.max("all_n").alias("n"), F.max("all_one").alias("one"), F.max("all_b").alias("sum_w"))
    out = match(g, _variance(match(scored.select(*keys, "_strata", "squares", "score", "seen"), counts, ["_strata"]), keys), keys, "left")
    return out.select(*keys, "estimate", F.sqrt(F.greatest("var", F.lit(0.0))).alias("se"), "n", "one", "sum_w", "n_psu", "n_strata", (F.col("n_psu") - F.col("n_strata")).alias("df"))


def axis_bins(frame: DataFrame, value: str, design: Design = Design(), most: int = 10) -> DataFrame:
    """`frame` with bin and bin_label: integer-wide bins between the weighted 1st and 99th percentiles, tails folded in."""
    lo, hi = (r["estimate"] for r in weighted_quantile(frame, value, design, (0.01, 0.99), policy=NO_SUPPRESSION).orderBy("p").collect())
    width = max(1, int(np.ceil((np.floor(hi) - np.floor(lo) + 1) / most)))
    first = int(np.floor(lo))
    last = int((np.floor(hi) - first) // width)
    b = F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(value) - first) / width))).cast("int")
    start = F.lit(first) + b * width
    label = F.when(F.lit(width) == 1, start.cast("string")).otherwise(F.concat(start.cast("string"), F.lit("-"), (start + width - 1).cast("string")))
    return frame.withColumns({"bin": F.when(F.col(value).isNotNull(), b), "bin_label": F.when(F.col(value).isNotNull(), label)})


# --- regressions: rows are summed to cells of equal (group, predictor, x, y, controls), cells to Gram tables

# Rounds, stop and bounds of the logistic fit, and the residual share at which a column is dependent.
ROUNDS, STOP, LEAST_P, DEPENDENT = 100, 1e-11, 1e-10, 1e-8
ONE, X, TARGET, DEVIANCE = "1", "x", "y", "~deviance"


def regression_answers(frame: DataFrame, outcome: str, predictors: list[str], controls: list[str], design: Design, by: list[str]) -> DataFrame:
    """(by, _strata, _psu, _w, _y, a _c for each control, a _x for each predictor) of every row, complete or not."""
    unit = [F.col(design.strata).alias("_strata"), F.col(design.psu).alias("_psu")] if design.strata else [F.lit(0).alias("_strata"), F.lit(0).alias("_psu")]
    answers = [F.col(c).alias(f"_c{i}") for i, c in enumerate(controls)] + [F.col(p).cast("double").alias(f"_x{i}") for i, p in enumerate(predictors)]
    return frame.select(*by, *unit, F.col(design.weight).cast("double").alias("_w"), F.col(outcome).cast("double").alias("_y"), *answers)


def regression_rows(answers: DataFrame, predictors: list[str], controls: list[str], by: list[str]) -> DataFrame:
    """(by, predictor, x, y, c, _strata, _psu, _w): the complete rows of every predictor, from `regression_answers`."""
    given = [F.col(f"_c{i}") for i in range(len(controls))]
    rows = answers.where(all_of([c.isNotNull() for c in (F.col("_y"), *given)]))
    control = F.array(*[c.cast("string") for c in given]) if controls else F.array().cast("array<string>")
    each = F.inline(F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(f"_x{i}").alias("x")) for i, p in enumerate(predictors)]))
    return rows.select(*by, F.col("_y").alias("y"), control.alias("c"), "_strata", "_psu", "_w", each).where("x is not null")


def _cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_w")).alias("sww"), F.sum(F.lit(1)).alias("n"))


def regression_cells(frame: DataFrame, outcome: str, predictors: list[str], controls: list[str], design: Design, by: list[str]) -> DataFrame:
    """(by, predictor, x, y, c, _strata, _psu, sw, sww, n): complete rows of every predictor summed by equal answers."""
    rows = regression_rows(regression_answers(frame, outcome, predictors, controls, design, by), predictors, controls, by)
    return _cells(rows, [*by, "predictor", "x", "y", "c", "_strata", "_psu"])


def _dummy(level: F.Column, control: F.Column) -> F.Column:
    return F.concat(F.lpad(control.cast("string"), 3, "0"), F.lit("="), level)


def grouped_gram(rows: DataFrame, keys: list[str], weight: str = "sw", target: str = "y", sums: dict[str, F.Column] | None = None) -> DataFrame:
    """(keys, i, j, v): sums of weight * z_i * z_j over `rows(keys, x, c, weight, target)` for the columns z: 1, a dummy
    for each control and level, x and y, the target.  i is not behind j in the order of names.  `sums` are summed along,
    as entries (name, name)."""
    entry = lambda k, v: F.struct(k.alias("k"), v.cast("double").alias("v"))
    columns = F.concat(F.array(entry(F.lit(ONE), F.lit(1.0))), F.transform("c", lambda level, i: entry(_dummy(level, i), F.lit(1.0))), F.array(entry(F.lit(X), F.col("x")), entry(F.lit(TARGET), F.col(target))))
    product = lambda a: F.transform(F.filter("z", lambda b: b["k"] >= a["k"]), lambda b: F.struct(a["k"].alias("i"), b["k"].alias("j"), (F.col("_w") * (a["v"] * b["v"])).alias("p")))
    more = [F.struct(F.lit(k).alias("i"), F.lit(k).alias("j"), v.cast("double").alias("p")) for k, v in (sums or {}).items()]
    each = rows.select(*keys, F.col(weight).cast("double").alias("_w"), columns.alias("z"), F.array(*more).cast("array<struct<i:string,j:string,p:double>>").alias("more"))
    pairs = each.select(*keys, F.inline(F.concat(F.flatten(F.transform("z", product)), F.col("more"))))
    return pairs.groupBy(*keys, "i", "j").agg(F.sum("p").alias("v"))


def _independent(gram: np.ndarray, tol: float = DEPENDENT) -> list[int]:
    """Columns that earlier ones do not give: each column's residual against those taken, from the Gram matrix."""
    taken: list[int] = []
    for i, own in enumerate(np.diag(gram)):
        explained = gram[i, taken] @ np.linalg.solve(gram[np.ix_(taken, taken)], gram[taken, i]) if taken else 0.0
        if own > 0 and own - explained > tol * own:
            taken.append(i)
    return taken


def solve_gram(cells: pd.DataFrame) -> tuple[dict | None, dict | None]:
    """(coefficients, row of the inverse for x) by column from one group's Gram cells (i, j, v) and its number of rows n;
    None for an undefined fit: x depends on the controls, or there are too few rows."""
    names = sorted(set(cells["i"]) | set(cells["j"]))
    at = {k: i for i, k in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    i, j = cells["i"].map(at), cells["j"].map(at)
    gram[i, j] = gram[j, i] = cells["v"]
    dummies = [k for k in names if "=" in k]
    first = {k.split("=", 1)[0]: k for k in reversed(dummies)}  # the least level of each control is the base
    columns = [ONE, *[k for k in dummies if first[k.split("=", 1)[0]] != k]]
    pick = lambda ks: np.array([at[k] for k in ks])
    order = pick(columns)
    columns = [columns[k] for k in _independent(gram[np.ix_(order, order)])] + [X]
    order = pick(columns)
    info = gram[np.ix_(order, order)]
    if len(_independent(info)) < len(columns) or cells["n"].iloc[0] <= len(columns):
        return None, None
    try:
        inverse = np.linalg.inv(info)
    except np.linalg.LinAlgError:
        return None, None
    coef = np.linalg.solve(info, gram[order, at[TARGET]])
    return dict(zip(columns, coef.tolist(), strict=True)), dict(zip(columns, inverse[-1].tolist(), strict=True))


def _key_fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def _fits(gram: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coef, inverse): maps by column, from Gram tables of k * k rows a group; null for undefined fits."""
    wide = match(gram, sizes.select(*keys, "n", "usable"), keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        coef, inverse = solve_gram(pdf) if pdf["usable"].iloc[0] else (None, None)
        out = pdf[keys].head(1).copy()
        out["coef"], out["inverse"] = [coef], [inverse]
        return out

    return wide.groupBy(*keys).applyInPandas(fit, f"{_key_fields(wide, keys)}, coef map<string,double>, inverse map<string,double>")


def _linear(m: str, x: F.Column) -> F.Column:
    """Sum of the columns of a row with the weights of map m; columns that are not in it count nothing."""
    of = lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0))
    return F.aggregate(F.transform("c", lambda level, i: of(_dummy(level, i))), of(F.lit(ONE)) + of(F.lit(X)) * x, lambda a, b: a + b)


def _mean(eta: F.Column, binomial: bool) -> F.Column:
    return F.greatest(F.lit(LEAST_P), F.least(F.lit(1 - LEAST_P), 1 / (1 + F.exp(-eta)))) if binomial else eta


def logistic_fits(cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, coef, inverse, rounds) by reweighted least squares.  A round is one aggregation of the open groups' cells to
    Gram tables and deviances, and one solution of each; a group whose deviance has settled is frozen with its fit, and
    its cells are in no later round.  A fit that has not settled after ROUNDS is undefined."""
    still = kept(sizes.select(*keys, "n", "usable", F.lit(None).cast("map<string,double>").alias("coef"), F.lit(None).cast("double").alias("was")))
    frozen = []
    for number in range(1, ROUNDS + 1):
        work = match(cells, still.select(*keys, "coef"), keys)
        mu = _mean(_linear("coef", F.col("x")), True) if number > 1 else (F.col("y") + 0.5) / 2
        work = work.withColumn("mu", F.greatest(F.lit(LEAST_P), F.least(F.lit(1 - LEAST_P), mu))).withColumn("v", F.col("mu") * (1 - F.col("mu")))
        eta = _linear("coef", F.col("x")) if number > 1 else F.log(F.col("mu") / (1 - F.col("mu")))
        work = work.withColumns({"work_w": F.col("sw") * F.col("v"), "work_y": eta + (F.col("y") - F.col("mu")) / F.col("v")})
        lost = -2 * F.col("sw") * F.log(F.when(F.col("y") == 1, F.col("mu")).otherwise(1 - F.col("mu")))
        wide = match(grouped_gram(work, keys, "work_w", "work_y", {DEVIANCE: lost}), still.select(*keys, "n", "usable", "was"), keys)

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            moments, deviance = pdf[pdf["i"] != DEVIANCE], float(pdf.loc[pdf["i"] == DEVIANCE, "v"].iloc[0])
            coef, inverse = solve_gram(moments) if pdf["usable"].iloc[0] else (None, None)
            was = pdf["was"].iloc[0]
            settled = coef is None or (pd.notna(was) and abs(deviance - was) / (abs(deviance) + 0.1) < STOP)
            out = pdf[[*keys, "n", "usable"]].head(1).copy()
            out["coef"], out["inverse"], out["was"], out["settled"] = [coef], [inverse], deviance, settled
            return out

        fits = kept(wide.groupBy(*keys).applyInPandas(fit, f"{_key_fields(wide, keys)}, n long, usable boolean, coef map<string,double>, inverse map<string,double>, was double, settled boolean").withColumn("rounds", F.lit(number)))
        frozen.append(fits.where("settled").select(*keys, "coef", "inverse", "rounds"))
        still = fits.where("not settled")
        if not still.limit(1).count():
            break
    else:
        none = F.lit(None).cast("map<string,double>")
        frozen.append(still.select(*keys, none.alias("coef"), none.alias("inverse"), "rounds"))
    return reduce(DataFrame.unionByName, frozen)


def adjusted_associations(frame: DataFrame, outcome: str, predictors: list[str], controls: list[str], design: Design = Design(), by=(), family: str = "gaussian", policy: Policy = NO_SUPPRESSION) -> DataFrame:
    """Coefficient of each predictor, one at a time, with dummy-coded controls, per group: rows beta and beta_per_sd.

    All predictors and groups are fitted together: rows become cells, cells Gram tables, and only those reach Python.
    The influence of every row goes through the same unit totals and Taylor variance as every other estimator; without
    a design the error is the model's, on the effective sample size.

    With a design, the answers are written once, units together, and read for the cells, the units and the design's
    counts.  Cells do not tell units apart: cells of units are nearly as many as the rows, and one task would hold its
    share of them.
    """
    if family not in ("gaussian", "binomial"):
        raise ValueError(f"unknown family {family!r}")
    if not predictors or {outcome, *controls} & set(predictors) or outcome in controls:
        raise ValueError("predictors, outcome and controls must differ")
    by, binomial = list(by), family == "binomial"
    controls = [c for c in dict.fromkeys(controls) if c not in by]
    keys = [*by, "predictor"]
    answers = regression_answers(frame, outcome, predictors, controls, design, by)
    if design.strata:
        answers = rewritten(answers.hint("rebalance", F.col("_strata"), F.col("_psu")))
    rows = regression_rows(answers, predictors, controls, by)
    cells = kept(_cells(rows, [*keys, "x", "y", "c"]))
    mean = F.sum(F.col("sw") * F.col("x")) / F.sum("sw")
    usable = F.min("y") != F.max("y") if binomial else F.lit(True)
    sizes = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sw").alias("sum_w"), F.sum("sww").alias("sww"), mean.alias("mx"), F.coalesce(usable, F.lit(False)).alias("usable"))
    centred = kept(match(cells, sizes.select(*keys, "mx"), keys).withColumn("x", F.col("x") - F.col("mx")).select(*keys, "x", "y", "c", "sw"))
    variance = centred.groupBy(*keys).agg((F.sum(F.col("sw") * F.col("x") * F.col("x")) / F.sum("sw")).alias("var_x"))
    sizes = kept(match(sizes, variance, keys).withColumn("sd_x", F.sqrt(F.greatest("var_x", F.lit(0.0)))))
    fits = logistic_fits(centred, sizes, keys) if binomial else kept(_fits(grouped_gram(centred, keys), sizes, keys))
    recs = match(sizes, fits.select(*keys, F.try_element_at("coef", F.lit(X)).alias("beta"), F.try_element_at("inverse", F.lit(X)).alias("inverse_x"), F.size("coef").alias("p")), keys, "left")
    fits = match(fits.where("coef is not null"), sizes.select(*keys, "mx"), keys)
    if design.strata:
        x = F.col("x") - F.col("mx")
        score = F.col("_w") * _linear("inverse", x) * (F.col("y") - _mean(_linear("coef", x), binomial))
        units = match(rows, small_side(fits, 10_000), keys).groupBy(*keys, "_strata", "_psu").agg(F.sum(score).alias("z"))
        recs = match(recs, taylor_variance(units, design_counts(answers, Design("_w", "_strata", "_psu")), keys), keys, "left")
        recs = recs.withColumns({"se": F.sqrt(F.greatest("var", F.lit(0.0))), "df": F.col("n_psu") - F.col("n_strata")})
    else:
        n_eff = F.col("sum_w") * F.col("sum_w") / F.col("sww")
        fitted, off = match(centred, fits, keys), F.col("y") - _mean(_linear("coef", F.col("x")), binomial)
        scale = F.lit(1.0) if binomial else F.col("sse") / F.col("sum_w") * n_eff / (n_eff - F.col("p"))
        recs = match(recs, fitted.groupBy(*keys).agg(F.sum(F.col("sw") * off * off).alias("sse")), keys, "left")
        recs = recs.withColumn("se", F.when(n_eff > F.col("p"), F.sqrt(scale * F.col("inverse_x") * F.col("sum_w") / n_eff)))
        recs = recs.withColumns({c: F.lit(None).cast("long") for c in ("n_psu", "n_strata", "df")})
    pair = F.inline(F.array(F.struct(F.lit("beta").alias("measure"), F.lit(1.0).alias("k")), F.struct(F.lit("beta_per_sd").alias("measure"), F.col("sd_x").alias("k"))))
    out = recs.select(*keys, "beta", "se", "n", "sum_w", "n_psu", "n_strata", "df", pair)
    out = out.withColumns({"estimate": F.col("beta") * F.col("k"), "se": F.when(F.col("beta").isNotNull(), F.col("se") * F.col("k"))}).drop("beta", "k")
    return suppress_small_cells(out, policy, columns=("estimate", "se"))


def adjusted_association(frame: DataFrame, outcome: str, predictor: str, controls: list[str], design: Design = Design(), by=(), family: str = "gaussian", policy: Policy = NO_SUPPRESSION) -> DataFrame:
    """The same for one predictor, without the column predictor."""
    return adjusted_associations(frame, outcome, [predictor], controls, design, by, family, policy).drop("predictor")


def ranked_adjusted(estimates: DataFrame, by: list[str], min_n: int = 100, limit: int = 20) -> DataFrame:
    """Predictors of an adjusted sweep ranked by their median |beta_per_sd|."""
    return ranked_correlates(estimates.where("measure = 'beta_per_sd'"), by, min_n, limit)
