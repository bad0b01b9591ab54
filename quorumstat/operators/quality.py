"""Data-quality checks: each gives rows (name, observed, expected, passed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _checks(df: DataFrame, observed: dict[str, Column], expected: dict[str, float]) -> DataFrame:
    """One aggregation, one row a check."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in observed.items()])
    rows = [F.struct(F.lit(n).alias("name"), F.col(n).alias("observed"), F.lit(float(expected[n])).alias("expected")) for n in observed]
    return one.select(F.inline(F.array(*rows))).withColumn("passed", F.col("observed").eqNullSafe(F.col("expected")))


def violations(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def check_row_counts(df: DataFrame, id_col: str, country: str, expected: dict[str, float]) -> DataFrame:
    return _checks(df, {"rows": F.count("*"), "unique_ids": F.countDistinct(id_col), "countries": F.countDistinct(country)}, expected)


def check_waves_design(df: DataFrame, expected: dict[str, float]) -> DataFrame:
    share = F.round(F.avg(F.col("retained_y2").cast("double")), 6)
    n = lambda c: violations(c)
    return _checks(
        df,
        {"retention": share, "midyear_type_1": n(F.col("midyear_type") == 1), "midyear_type_2": n(F.col("midyear_type") == 2), "strata": F.countDistinct("strata"), "psus": F.countDistinct("strata", "psu"), "type_without_midyear": n(F.col("midyear_type").isNotNull() & ~F.col("has_midyear"))},
        expected,
    )


def check_demographics(df: DataFrame, code: str, lo: float, hi: float, state: str, weight: str) -> DataFrame:
    """Codes in range; a state is null exactly where its weight is."""
    obs = {"out_of_range": violations(~F.col(code).between(lo, hi)), "state_weight_mismatch": violations(F.col(state).isNull() != F.col(weight).isNull())}
    return _checks(df, obs, dict.fromkeys(obs, 0))


def check_long(long: DataFrame, lo: int, hi: int, sentinels: list[int], coverage: DataFrame | None = None) -> DataFrame:
    """Duplicate keys; values along with a non-response; values out of range; sentinels left as values; with `coverage`
    (variable, wave, n_valid), variables and waves whose valid values are not as many as it says."""
    keys = long.groupBy("id", "wave", "variable").agg(
        (F.count("*") > 1).cast("int").alias("dup"), violations(F.col("value").isNotNull() & F.col("nonresponse").isNotNull()).alias("both"),
        violations(~F.col("value").between(lo, hi)).alias("range"), violations(F.col("value").isin(sentinels)).alias("sentinel"),
    )
    obs = {c: F.coalesce(F.sum(c), F.lit(0)) for c in ("dup", "both", "range", "sentinel")}
    found = _checks(keys, obs, dict.fromkeys(obs, 0))
    if coverage is None:
        return found
    seen = long.groupBy(F.col("variable").alias("_v"), F.col("wave").alias("_w")).agg(F.count("value").alias("seen"))
    both = coverage.join(seen, (F.col("variable") == F.col("_v")) & (F.col("wave") == F.col("_w")), "full")
    off = both.select((~F.col("n_valid").eqNullSafe(F.col("seen"))).cast("int").alias("off"))
    return found.unionByName(_checks(off, {"coverage": F.coalesce(F.sum("off"), F.lit(0))}, {"coverage": 0}))


def check_country_prefix(long: DataFrame, country: str = "country_code") -> DataFrame:
    """(variable, n): values of 100 and more whose hundreds are not the country of the row."""
    wrong = (F.col("value") >= 100) & ~F.floor(F.col("value") / 100).eqNullSafe(F.col(country))
    return long.where(wrong).groupBy("variable").agg(F.count("*").alias("n"))


def check_scores(derived: DataFrame, ranges: dict[str, tuple[float, float]], items: dict[str, tuple[str, int]], wave: str = "wave") -> DataFrame:
    """(wave, score, n_valid, out_of_range, too_few_items): by wave, scores outside their range, and scores given although
    fewer items were answered than they need.  items: score -> (column with the items answered, least number)."""
    rows = []
    for name, (lo, hi) in ranges.items():
        c, (count, least) = F.col(name), items.get(name, (None, 0))
        few = F.col(count) < least if count else F.lit(False)
        rows.append(F.struct(F.lit(name).alias("score"), c.isNotNull().alias("valid"), (~c.between(lo, hi)).alias("off"), (c.isNotNull() & few).alias("few")))
    each = derived.select(wave, F.inline(F.array(*rows)))
    n = lambda x: F.count(F.when(F.col(x), 1))
    return each.groupBy(wave, "score").agg(n("valid").alias("n_valid"), n("off").alias("out_of_range"), n("few").alias("too_few_items"))


def code_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, code, n): how often each code stands in each column, nulls included."""
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("code")) for c in columns]))
    return rows.select(each).groupBy("variable", "code").agg(F.count("*").alias("n"))


def check_labelled(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Values without a label, by variable."""
    v = long.where("value is not null").groupBy("variable", "value").agg(F.count("*").alias("n"))
    return v.join(labels, (v["variable"] == labels["variable"]) & (v["value"] == labels["code"]), "left_anti")


def check_schema(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """rules: column -> any of nullable, allowed, low, high, regex, unique.  Violations of every rule in one pass."""
    obs: dict[str, Column] = {}
    for c, r in rules.items():
        col = F.col(c)
        if r.get("nullable") is False:
            obs[f"{c}:null"] = violations(col.isNull())
        if "allowed" in r:
            obs[f"{c}:allowed"] = violations(~col.isin(r["allowed"]))
        if "low" in r:
            obs[f"{c}:low"] = violations(col < r["low"])
        if "high" in r:
            obs[f"{c}:high"] = violations(col > r["high"])
        if "regex" in r:
            obs[f"{c}:regex"] = violations(~F.rlike(col, F.lit(r["regex"])))
        if r.get("unique"):
            obs[f"{c}:unique"] = F.count(col) - F.countDistinct(col)
    return _checks(df, obs, dict.fromkeys(obs, 0))


def check_derived(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    obs = {c: violations(~F.col(c).between(lo, hi)) for c, (lo, hi) in ranges.items()}
    return _checks(df, obs, dict.fromkeys(obs, 0))


def check_published(means: DataFrame, published: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Estimates against published ones, within a tolerance."""
    p = published.select(F.col(key).alias("_k"), F.col("expected"))
    return means.join(p, F.col(key) == F.col("_k")).select(F.col(key).cast("string").alias("name"), F.col("estimate").alias("observed"), "expected", (F.abs(F.col("estimate") - F.col("expected")) <= tolerance).alias("passed"))


def check_published_ranking(means: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """`published(key, expected, tolerance, place)` against `means(key, estimate)`: figures within each row's tolerance, and
    places from the top, or from the bottom where negative, among all groups that have an estimate.  A published group
    without an estimate passes neither; a null place is not checked."""
    have = means.where(F.col("estimate").isNotNull())  # a row for each group
    place = lambda order: F.row_number().over(Window.orderBy(order, F.col(key)))
    ranked = have.select(F.col(key).alias("_k"), "estimate", place(F.desc("estimate")).alias("_down"), F.negate(F.row_number().over(Window.orderBy("estimate", F.desc(key)))).alias("_up"))
    both = published.join(ranked, F.col(key) == F.col("_k"), "left")
    seen = F.when(F.col("place") < 0, F.col("_up")).when(F.col("place") > 0, F.col("_down"))
    near = F.coalesce(F.abs(F.col("estimate") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return both.select(F.col(key).cast("string").alias("name"), F.col("estimate").alias("observed"), "expected", near.alias("passed"), "place", seen.alias("observed_place"), (F.col("place").isNull() | F.coalesce(seen == F.col("place"), F.lit(False))).alias("in_place"))


def check_monotone(means: DataFrame, order: str, rising: bool = True, slack: float = 1e-9) -> DataFrame:
    """(name, observed, expected, passed): each group's estimate against that of the group before it in `order`; the first, and
    groups without an estimate, pass."""
    have = means.where(F.col("estimate").isNotNull())  # a row for each group
    before = F.lag("estimate").over(Window.orderBy(order))
    step = (F.col("estimate") - before) if rising else (before - F.col("estimate"))
    return have.select(F.col(order).cast("string").alias("name"), F.col("estimate").alias("observed"), before.alias("expected"), F.coalesce(step >= -slack, F.lit(True)).alias("passed"))


def retention_report(df: DataFrame, country: str = "country_code") -> DataFrame:
    pct = lambda c: 100 * F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    n = lambda t: violations(F.col("midyear_type") == t).cast("long")
    return df.groupBy(country).agg(F.count("*").alias("n"), pct(F.col("retained_y2")).alias("pct_retained"), pct(F.col("has_midyear")).alias("pct_midyear"), n(1).alias("n_type_1"), n(2).alias("n_type_2"))
