"""Design-based estimation from sampling-unit totals.

Every estimator is a weighted mean of one or more score columns.  The frame is aggregated
once to (group, strata, psu) totals; groups, design counts, estimates, linearised scores,
three-branch stratum variances and intervals all come from that much smaller table.  The
design is the whole frame: a null value leaves the estimate, never the design.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and Spark runs on this machine alone."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def rewritten(df: DataFrame) -> DataFrame:
    """The same rows as a table written to the shared folder: for loops that join a result with itself.  A checkpoint keeps
    the size that was estimated before it, which such joins multiply round by round; a written table has its own."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, counted now; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


RESULT_COLUMNS = (
    "stat", "estimate", "se", "ci_lo", "ci_hi", "ci_level", "ci_method", "n", "sum_w", "n_psu", "n_strata", "df", "se_method", "weight", "suppressed", "flagged",
)
#: A standard error at or below this is zero up to rounding and gets no interval.
ZERO_SE = 1e-9


@dataclass(frozen=True)
class Design:
    """Names of the weight, strata and sampling-unit columns; strata and psu come together or not at all."""

    weight: str = "w"
    strata: str | None = "strata"
    psu: str | None = "psu"

    def __post_init__(self):
        if (self.strata is None) != (self.psu is None):
            raise ValueError("strata and psu must both be given or both be left out")

    @property
    def method(self) -> str:
        return "kish" if self.strata is None else "taylor"


# The thresholds of the policies.
@dataclass(frozen=True)
class Policy:
    """Cells below `threshold` are suppressed; shown cells resting on fewer than `flag_below` are flagged."""

    threshold: int = 50
    flag_below: int = 100


DEFAULT_POLICY, NO_SUPPRESSION, SERVING_POLICY = Policy(), Policy(0, 0), Policy(0, 30)


@dataclass(frozen=True)
class Item:
    """One score column, with the literal keys (level, leg, measure ...) of its result rows."""

    value: Column
    keys: tuple[tuple[str, object], ...] = ()
    domain: Column | None = None


def design_counts(frame: DataFrame, design: Design) -> DataFrame:
    """(_strata, nh): sampling units of each stratum in the whole frame."""
    return frame.groupBy(F.col(design.strata).alias("_strata")).agg(F.countDistinct(design.psu).alias("nh"))


def unit_table(frame: DataFrame, items: list[Item], design: Design, by: list[str]) -> DataFrame:
    """by, _strata, _psu and `rows`, an array with a struct for each item: its keys, sw, swy, n, one (and sww, swyy).

    One aggregation over the rows; units without valid rows stay, since they are part of the design.  The totals are
    one column, so that every reader of this table asks for the same columns and Spark reuses its exchange.
    """
    w = F.col(design.weight).cast("double")
    unit = [F.col(design.strata).alias("_strata"), F.col(design.psu).alias("_psu")] if design.strata else [F.lit(0).alias("_strata"), F.lit(0).alias("_psu")]
    rows = []
    for item in items:
        y = item.value.cast("double") if item.domain is None else F.when(item.domain, item.value.cast("double"))
        wy = F.when(y.isNotNull(), w)
        sums = {"sw": F.sum(wy), "swy": F.sum(wy * y), "n": F.count(y), "one": F.count(F.when(y == 1, 1))}
        if not design.strata:
            sums |= {"sww": F.sum(wy * wy), "swyy": F.sum(wy * y * y)}
        rows.append(F.struct(*[F.lit(v).alias(k) for k, v in item.keys], *[c.alias(k) for k, c in sums.items()]))
    return frame.groupBy(*[F.col(c) for c in by], *unit).agg(F.array(*rows).alias("rows")).repartition("_strata", "_psu")


def unit_counts(units: DataFrame) -> DataFrame:
    """(_strata, nh) of a unit table: the sampling units of each stratum, with or without valid rows."""
    return units.where(F.size("rows") > 0).groupBy("_strata").agg(F.countDistinct("_psu").alias("nh"))


def match(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Join on equal keys, kept once; null keys match nothing unless null_safe.  Without keys, both sides have one row."""
    if not keys:
        return a.join(F.broadcast(b), F.lit(True), how)
    renamed = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    equal = lambda k: F.col(k).eqNullSafe(F.col(f"_k_{k}")) if null_safe else F.col(k) == F.col(f"_k_{k}")
    return a.join(renamed, reduce(lambda x, y: x & y, map(equal, keys)), how).drop(*[f"_k_{k}" for k in keys])


def prefix_sums(sums: DataFrame, by: list[str], value: str, totals: dict[str, str]) -> DataFrame:
    """`sums(by, value, ...)`, a row for each value of a group, with a running total for each of `totals` {new: column}, over
    the values up to and with the row's, and `{new}_all`, the group's whole total.

    Rows are dealt out by ranges of (group, value).  Each range runs its own sums, and begins with the totals of the
    ranges before it; only a row for each group and range is summed in one task.  So the values of a group may be of
    any number, and one group may hold most of them.
    """
    placed = kept(sums.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    each = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in totals.items()])
    group = [F.col(c) for c in by] or [F.lit(1)]
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = each.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in totals], *[F.sum(f"_{n}").over(W.partitionBy(*group)).alias(f"{n}_all") for n in totals])
    run = W.partitionBy(*[F.col(c) for c in by], "_range").orderBy(value)
    local = placed.withColumns({n: F.sum(c).over(run) for n, c in totals.items()})
    out = match(local, starts, [*by, "_range"], null_safe=True)
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in totals}).drop("_range", *[f"_{n}" for n in totals])


def taylor_variance(units: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, var, n_psu, n_strata from unit scores `units(keys, _strata, _psu, z)` and `counts(_strata, nh)`."""
    strata = units.groupBy(*keys, "_strata").agg(F.sum(F.col("z") * F.col("z")).alias("squares"), F.sum("z").alias("score"), F.count("*").alias("seen"))
    return _variance(strata.join(counts, "_strata"), keys)


def _variance(strata: DataFrame, keys: list[str]) -> DataFrame:
    """From `strata(keys, squares, score, seen, nh)`, a row for each stratum of a group: the between-unit variance; around
    the group's mean unit score where a stratum has one unit, or one of several is seen."""
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    mean = F.sum("score").over(whole) / F.sum("nh").over(whole)
    off, all_units = F.col("score") - mean, F.col("nh").cast("double")
    widen = all_units / (all_units - 1)
    part = F.when(F.col("nh") == 1, off * off)
    part = part.when(F.col("seen") == 1, widen * (off * off + (all_units - 1) * mean * mean))
    part = part.otherwise(widen * (F.col("squares") - F.col("score") * F.col("score") / all_units))
    return strata.withColumn("part", part).groupBy(*keys).agg(F.sum("part").alias("var"), F.sum("seen").alias("n_psu"), F.count("*").alias("n_strata"))


def records(frame: DataFrame, items: list[Item], design: Design, by: list[str]) -> DataFrame:
    """by, item keys, estimate, se, n, one (rows scored 1), sum_w, n_psu, n_strata, df for every group seen and every item;
    a group with a null key has no estimate."""
    keys = [*by, *[k for k, _ in items[0].keys]]
    units = unit_table(frame, items, design, by)
    each = units.select(*by, "_strata", "_psu", F.inline("rows"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.lit(True))
    total = lambda c: F.sum(F.when(known, F.col(c))).alias(c)
    sums = [total(c) for c in ("swy", "sw", "n", "one")]
    none = F.lit(None).cast("long")
    if design.strata is None:
        g = each.groupBy(*keys).agg(*sums, total("sww"), total("swyy"))
        g = g.withColumnRenamed("sw", "sum_w").withColumn("estimate", F.when(F.col("n") > 0, F.col("swy") / F.col("sum_w")))
        n_eff = F.col("sum_w") * F.col("sum_w") / F.col("sww")
        spread = F.greatest((F.col("swyy") / F.col("sum_w") - F.col("estimate") * F.col("estimate")) * (n_eff / (n_eff - 1)) / n_eff, F.lit(0.0))
        return g.select(*keys, "estimate", F.when(n_eff > 1, F.sqrt(spread)).alias("se"), "n", "one", "sum_w", none.alias("n_psu"), none.alias("n_strata"), none.alias("df"))
    return group_records(each, unit_counts(units), keys, known)


def group_records(each: DataFrame, counts: DataFrame, keys: list[str], known: Column) -> DataFrame:
    """keys, estimate, se, n, one, sum_w, n_psu, n_strata, df from unit totals `each(keys, _strata, _psu, sw, swy, n, one)` and
    `counts(_strata, nh)`; groups that are not `known` have no estimate."""
    total = lambda c: F.sum(F.when(known, F.col(c))).alias(c)
    g = each.groupBy(*keys).agg(*[total(c) for c in ("swy", "sw", "n", "one")])
    g = g.withColumn("estimate", F.when(F.col("n") > 0, F.col("swy") / F.col("sw"))).withColumnRenamed("sw", "sum_w").drop("swy")
    scored = match(each.where(F.col("n") > 0), g.select(*keys, F.col("estimate").alias("e"), F.col("sum_w").alias("sum_all")), keys)
    scored = scored.select(*keys, "_strata", "_psu", ((F.col("swy") - F.col("e") * F.col("sw")) / F.col("sum_all")).alias("z"))
    out = match(g, taylor_variance(scored, counts, keys), keys, "left")
    return out.select(*keys, "estimate", F.when(F.col("var").isNotNull(), F.sqrt(F.greatest("var", F.lit(0.0)))).alias("se"), "n", "one", "sum_w", "n_psu", "n_strata", (F.col("n_psu") - F.col("n_strata")).alias("df"))


def grid(frame: DataFrame, by: list[str], keyed: list[tuple[tuple[str, object], ...]]) -> DataFrame:
    """Every observed group with every item's keys, where the records hold only groups with valid rows."""
    rows = F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in ks]) for ks in keyed]))
    return (frame.select(*by).distinct() if by else frame.sparkSession.range(1)).select(*by, rows)


def suppress_small_cells(df: DataFrame, policy: Policy = DEFAULT_POLICY, n: str = "n", base: str = "n", columns: tuple[str, ...] = ("estimate", "se", "ci_lo", "ci_hi")) -> DataFrame:
    """Adds suppressed and flagged, and nulls `columns` of suppressed cells; counts stay."""
    hidden = F.col(n) < policy.threshold
    out = df.withColumns({"suppressed": hidden, "flagged": ~hidden & (F.col(base) < policy.flag_below) & F.col("estimate").isNotNull()})
    return out.withColumns({c: F.when(~F.col("suppressed"), F.col(c)) for c in columns if c in df.columns})


def finalize(
    recs: DataFrame, keys: list[str], stat: str, design: Design, policy: Policy = DEFAULT_POLICY, ci_level: float = 0.95, intervals: bool = True, share: bool = False, all_rows: DataFrame | None = None
) -> DataFrame:
    """Result records with intervals, suppression and flags.  share: n is the count at the level.  all_rows: the result
    has these keys, where the records lack some."""
    out = recs if all_rows is None else match(all_rows, recs, keys, "left")
    out = out.withColumn("n_base", F.coalesce("n", F.lit(0)))
    out = out.withColumns({"n": F.coalesce(F.col("one"), F.lit(0)).cast("long") if share else F.col("n_base"), "sum_w": F.coalesce("sum_w", F.lit(0.0))})
    z = NormalDist().inv_cdf((1 + ci_level) / 2)
    spread = (F.col("se") > ZERO_SE) if intervals else F.lit(False)
    out = out.withColumns(
        {
            "se": F.col("se") if intervals else F.lit(None).cast("double"),
            "ci_lo": F.when(spread, F.col("estimate") - z * F.col("se")),
            "ci_hi": F.when(spread, F.col("estimate") + z * F.col("se")),
            "stat": F.lit(stat), "ci_level": F.lit(ci_level), "ci_method": F.lit("normal" if intervals else "none"),
            "se_method": F.lit(design.method if intervals else "none"), "weight": F.lit(design.weight),
        }
    )
    out = suppress_small_cells(out, policy, "n", "n_base")
    return out.select(*keys, *RESULT_COLUMNS)
