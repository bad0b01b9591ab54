"""Wide to long, long to wide, and the frames that estimators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import orient_values


def build_respondents(raw: DataFrame, columns: dict[str, str], flags: dict[str, str], countries: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Renamed person columns, a flag for each wave marker that is not null, the country's name and optional extras."""
    people = raw.select(*[F.col(a).alias(b) for a, b in columns.items()], *[F.col(m).isNotNull().alias(f) for f, m in flags.items()])
    out = people.join(countries.select(F.col("code").alias("country_code"), F.col("name").alias("country_name")), "country_code", "left")
    return out.join(extras, "id", "left") if extras is not None else out


def unpivot_long(raw: DataFrame, id_col: str, by_wave: dict[str, dict[str, str]], sentinels: DataFrame) -> DataFrame:
    """(id, wave, variable, value, nonresponse): one row for each answer given; `by_wave` maps wave to {column: variable}.

    sentinels(variable, code, kind) is a catalog table; its codes become a null value with a non-response kind.
    """
    parts = []
    for wave, columns in by_wave.items():
        wide = raw.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(v) for c, v in columns.items()])
        parts.append(wide.unpivot("id", list(columns.values()), "variable", "raw").where("raw is not null").withColumn("wave", F.lit(wave)))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    s = sentinels.select(F.col("variable").alias("_v"), F.col("code").alias("_c"), F.col("kind").alias("nonresponse"))
    out = long.join(s, (F.col("variable") == F.col("_v")) & (F.col("raw") == F.col("_c")), "left")
    return out.select("id", "wave", "variable", F.when(F.col("nonresponse").isNull(), F.col("raw")).alias("value"), "nonresponse")


def pivot_wide(long: DataFrame, pool: DataFrame, items: list[str], wave: str | None = None) -> DataFrame:
    """One row for each person of `pool`, one column for each item."""
    rows = long.where(F.col("variable").isin(items))
    rows = rows.where(F.col("wave") == wave) if wave else rows
    wide = rows.groupBy(F.col("id").alias("_id")).agg(*[F.max(F.when(F.col("variable") == i, F.col("value"))).alias(i) for i in items])
    return pool.join(wide, F.col("id") == F.col("_id"), "left").drop("_id")


def multiwave_wide(long: DataFrame, pool: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The same with a column for each (item, wave)."""
    keep = F.lit(False)
    for i, w in columns:
        keep = keep | ((F.col("variable") == i) & (F.col("wave") == w))
    aggs = [F.max(F.when((F.col("variable") == i) & (F.col("wave") == w), F.col("value"))).alias(f"{i}_{w}") for i, w in columns]
    wide = long.where(keep).groupBy(F.col("id").alias("_id")).agg(*aggs)
    return pool.join(wide, F.col("id") == F.col("_id"), "left").drop("_id")


def answer_frame(long: DataFrame, pool: DataFrame, items: dict[str, str]) -> DataFrame:
    """Each question from its own answer wave; `items` maps variable to wave."""
    return multiwave_wide(long, pool, list(items.items())).select(*pool.columns, *[F.col(f"{i}_{w}").alias(i) for i, w in items.items()])


def analysis_frame(long: DataFrame, respondents: DataFrame, variable: str, wave: str, columns: list[str], variables: DataFrame | None = None) -> DataFrame:
    """One question at one wave with its respondents; with `variables`, values are oriented so that more is better."""
    cut = long.where((F.col("variable") == variable) & (F.col("wave") == wave)).select("id", "variable", "value")
    if variables is not None:
        cut = orient(cut, variables)
    return respondents.select("id", *columns).join(cut.select("id", "value"), "id")


def derived_frame(derived: DataFrame, respondents: DataFrame, score: str, wave: str, columns: list[str]) -> DataFrame:
    return respondents.select("id", *columns).join(derived.where(F.col("wave") == wave).select("id", F.col(score).alias("value")), "id")


def orient(long: DataFrame, variables: DataFrame) -> DataFrame:
    v = variables.select(F.col("name").alias("_n"), "direction", F.col("min").alias("_lo"), F.col("max").alias("_hi"))
    out = long.join(v, F.col("variable") == F.col("_n"), "left")
    return out.withColumn("value", orient_values(F.col("value"), F.coalesce("direction", F.lit("none")), F.col("_lo"), F.col("_hi"))).drop("_n", "direction", "_lo", "_hi")


def own_state(df: DataFrame, states: DataFrame, region: str, region_y2: str, in_group: str) -> DataFrame:
    """Postal code of each wave's region where the person is in the group; the second wave falls back to the first."""
    m = lambda c: states.select(F.col("region").alias(f"_{c}"), F.col("postal").alias(c))
    out = df.join(m("s1"), F.when(F.col(in_group), F.col(region)) == F.col("_s1"), "left").join(m("s2"), F.when(F.col(in_group), F.col(region_y2)) == F.col("_s2"), "left")
    return out.withColumns({"state": F.col("s1"), "state_y2": F.coalesce("s2", "s1")}).drop("_s1", "_s2", "s1", "s2")


def check_own_state(df: DataFrame, state: str, group: str) -> DataFrame:
    """Rows whose state is missing from their group's list ('AA_BB_CC')."""
    fits = F.array_contains(F.split(F.col(group), "_"), F.col(state))
    return df.where(F.col(group).isNotNull() & ~F.coalesce(fits, F.lit(False)))


def weighted_quintile(people: DataFrame, country: str = "country_code", code: str = "income_code", weight: str = "w") -> DataFrame:
    """Adds income_band and income_quintile: the quintile at the midpoint of the band's cumulative weight share."""
    banded = people.withColumn("income_band", (F.col(code) % 100).cast("int"))
    g = banded.where("income_band is not null").groupBy(F.col(country).alias("_c"), F.col("income_band").alias("_b")).agg(F.sum(weight).cast("double").alias("bw"))
    run, whole = W.partitionBy("_c").orderBy("_b"), W.partitionBy("_c")  # a row for each band
    share = F.col("bw") / F.sum("bw").over(whole)
    mid = F.sum("bw").over(run) / F.sum("bw").over(whole) - share / 2
    q = g.select("_c", "_b", (F.greatest(F.lit(0), F.least(F.floor(mid * 5), F.lit(4))) + 1).cast("int").alias("income_quintile"))
    return banded.join(q, (F.col(country) == F.col("_c")) & (F.col("income_band") == F.col("_b")), "left").drop("_c", "_b")


def coverage(long: DataFrame, respondents: DataFrame) -> DataFrame:
    """Per variable, wave and country: present, valid, skipped, dk, refused."""
    n = lambda k: F.sum(F.when(F.col("nonresponse") == k, 1).otherwise(0)).cast("long").alias(f"n_{k}")
    return long.join(respondents.select("id", "country_code"), "id").groupBy("variable", "wave", "country_code").agg(F.count("*").alias("n_present"), F.count("value").alias("n_valid"), n("skipped"), n("dk"), n("refused"))
