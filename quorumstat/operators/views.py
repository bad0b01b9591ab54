"""Every view of every outcome and wave from one scan: by country, by country and each demographic, histograms.

Answers are joined with their people once and summed to cells of equal answers within
country, demographics and sampling unit.  Grouping sets over the cells give the unit totals
of all views together; estimates, Taylor errors, intervals and flags come from those by the
same steps as every other estimator's.

Edge cases: the frame of an outcome and wave is its people who were asked, answered or not, and who are eligible
for the wave's weight; a null demographic is a group without an estimate; levels nobody
chose stay with a share of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import weights as WT
from .core import RESULT_COLUMNS, SERVING_POLICY, Design, Policy, finalize, group_records, kept

# Scales whose default statistic is the mean, and those that have a histogram.
MEAN_SCALES, HISTOGRAM_SCALES = ("scale_0_10", "count"), ("scale_0_10",)
#: Levels of an outcome; items of a catalog are a small table.
MAX_LEVELS, MAX_OUTCOMES = 1_000, 1_000
KEYS = ["outcome", "wave", "view", "country_code", "group", "item"]


def view_items(catalog: DataFrame) -> DataFrame:
    """(outcome, item, kind, level, whole): what is estimated for each outcome of catalog(name, scale_type, min, max): a mean
    or a share of each level, and the histogram's shares, which only the view by country has (whole)."""
    found = catalog.select("name", "scale_type", "min", "max").limit(MAX_OUTCOMES + 1).collect()
    rows = []
    for r in found:
        if r["max"] - r["min"] >= MAX_LEVELS:
            raise ValueError(f"{r['name']} has more than {MAX_LEVELS} levels")
        levels = range(r["min"], r["max"] + 1)
        if r["scale_type"] in MEAN_SCALES:
            rows.append((r["name"], "mean", "mean", None, False))
        else:
            rows += [(r["name"], f"proportion {x}", "proportion", x, False) for x in levels]
        if r["scale_type"] in HISTOGRAM_SCALES:
            rows += [(r["name"], f"distribution {x}", "distribution", x, True) for x in levels]
    if len(found) > MAX_OUTCOMES:
        raise ValueError(f"more than {MAX_OUTCOMES} outcomes")
    return catalog.sparkSession.createDataFrame(rows, "outcome string, item string, kind string, level int, whole boolean")


def view_cells(long: DataFrame, people: DataFrame, waves: list[str], demographics: list[str]) -> DataFrame:
    """(outcome, wave, country_code, demographics, _strata, _psu, value, sw, n): eligible rows of the waves summed by equal
    answers; strata are told apart by outcome and wave, whose frames differ."""
    weight = reduce(lambda c, w: c.when(F.col("wave") == w, F.when(WT.eligible(WT.resolve((w,))), F.col(WT.resolve((w,)).weight).cast("double"))), waves, F.when(F.lit(False), F.lit(0.0)))
    eligible = reduce(lambda c, w: c.when(F.col("wave") == w, WT.eligible(WT.resolve((w,)))), waves, F.when(F.lit(False), F.lit(False)))
    rows = long.where(F.col("wave").isin(waves)).select("id", "wave", F.col("variable").alias("outcome"), F.col("value").cast("double").alias("value")).join(people, "id").where(eligible)
    groups = ["outcome", "wave", "country_code", *demographics]
    strata, psu = F.struct("outcome", "wave", "strata").alias("_strata"), F.col("psu").alias("_psu")
    return rows.withColumn("_w", weight).groupBy(*groups, strata, psu, "value").agg(F.sum("_w").alias("sw"), F.count("*").alias("n"))


def view_units(cells: DataFrame, demographics: list[str]) -> DataFrame:
    """(outcome, wave, view, country_code, group, _strata, _psu, held): for every view's groups and sampling units, how the
    unit's answers are spread: an array of (value, sw, n), of as many entries as there are levels."""
    base = ["outcome", "wave", "country_code", "_strata", "_psu", "value"]
    sets = [base, *[[*base, d] for d in demographics]]
    places = [F.when(F.grouping(d) == 0, F.lit(k)) for k, d in enumerate(demographics, 1)]
    summed = cells.groupingSets(sets, *base, *demographics).agg(F.sum("sw").alias("sw"), F.sum("n").alias("n"), F.coalesce(*places, F.lit(0)).alias("_view"))
    view = F.get(F.array(F.lit("country_code"), *[F.lit(f"country_code-{d}") for d in demographics]), F.col("_view"))
    group = F.get(F.array(F.lit(""), *[F.col(d).cast("string") for d in demographics]), F.col("_view"))
    named = summed.select("outcome", "wave", view.alias("view"), "country_code", group.alias("group"), "_strata", "_psu", "value", "sw", "n")
    held = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "sw", "n")))
    return named.groupBy("outcome", "wave", "view", "country_code", "group", "_strata", "_psu").agg(held.alias("held"))


def view_estimates(long: DataFrame, people: DataFrame, catalog: DataFrame, waves: list[str], demographics: list[str], policy: Policy = SERVING_POLICY) -> DataFrame:
    """A result record for each (outcome, wave, view, country_code, group, kind, level); group is '' by country alone."""
    items = kept(view_items(catalog))
    cells = view_cells(long.join(F.broadcast(items.select(F.col("outcome").alias("variable")).distinct()), "variable", "left_semi"), people, waves, demographics)
    units = kept(view_units(kept(cells), demographics))
    each = units.join(F.broadcast(items), "outcome").where((F.col("view") == "country_code") | ~F.col("whole"))
    at = F.filter("held", lambda h: h["value"] == F.col("level"))
    total = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda acc, h: acc + of(h))
    mean = F.col("level").isNull()
    sums = {
        "sw": total(F.col("held"), lambda h: h["sw"]), "swy": F.when(mean, total(F.col("held"), lambda h: h["sw"] * h["value"])).otherwise(total(at, lambda h: h["sw"])),
        "n": total(F.col("held"), lambda h: h["n"]).cast("long"), "one": F.when(mean, F.lit(0)).otherwise(total(at, lambda h: h["n"])).cast("long"),
    }
    totals = each.select(*KEYS, "_strata", "_psu", *[c.alias(k) for k, c in sums.items()])
    counts = units.where("view = 'country_code'").groupBy("_strata").agg(F.countDistinct("_psu").alias("nh"))
    recs = kept(group_records(totals, counts, KEYS, F.col("country_code").isNotNull() & F.col("group").isNotNull()))
    design = Design()
    parts = [finalize(recs.where(of), KEYS, "", design, policy, share=share) for of, share in ((F.col("item") == "mean", False), (F.col("item") != "mean", True))]
    weight = reduce(lambda c, w: c.when(F.col("wave") == w, WT.resolve((w,)).weight), waves, F.when(F.lit(False), F.lit("")))
    out = parts[0].unionByName(parts[1]).withColumns({"stat": F.split_part("item", F.lit(" "), F.lit(1)), "level": F.expr("try_cast(split_part(item, ' ', 2) AS INT)"), "weight": weight})
    return out.select(*KEYS[:-1], "level", *RESULT_COLUMNS)
