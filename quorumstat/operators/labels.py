"""Work on label tables: non-response, scales, country labels, search and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What a label in parentheses must contain to be of a kind, first match first.
NONRESPONSE = (("skipped", "skip"), ("dk", "dk|know"), ("refused", r"refus|^\(rf\)$"))


def _first_rule(rules: list[tuple]) -> Column:
    """The value of the first rule (value, condition) that holds, null if none does."""
    return F.coalesce(*[F.when(condition, value) for value, condition in rules])


def classify_nonresponse(labels: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """Adds kind: skipped, dk, refused or unresolved for labels wholly in parentheses, null for answers.

    rulings (variable, code, ruling) win; the ruling 'valid' makes a parenthesised label an answer.
    """
    said = F.lower("label")
    kinds = [(F.lit(kind), F.rlike(said, F.lit(words))) for kind, words in NONRESPONSE]
    kind = F.when(F.rlike("label", F.lit(r"(?s)^\(.*\)$")), _first_rule([*kinds, (F.lit("unresolved"), F.lit(True))]))
    out = labels.withColumn("kind", kind)
    if rulings is None:
        return out
    r = rulings.select(F.col("variable").alias("_v"), F.col("code").alias("_c"), "ruling")
    out = out.join(r, (F.col("variable") == F.col("_v")) & (F.col("code") == F.col("_c")), "left")
    return out.withColumn("kind", F.when(F.col("ruling").isNull(), F.col("kind")).when(F.col("ruling") != "valid", F.col("ruling"))).drop("_v", "_c", "ruling")


def split_country_label(labels: DataFrame, countries: DataFrame) -> DataFrame:
    """Codes of 100 and more carry their country: adds country_code, short (label without the prefix), mismatch."""
    c = countries.select(F.col("code").alias("_cc"), F.col("name").alias("_name"))
    out = labels.join(c, (F.col("code") >= 100) & (F.floor(F.col("code") / 100) == F.col("_cc")), "left")
    prefix = F.concat(F.col("_name"), F.lit(": "))
    fits = F.startswith("label", prefix)
    return out.select(
        *labels.columns, F.when(fits, F.col("_cc")).alias("country_code"), F.when(fits, F.substring("label", F.char_length(prefix) + 1, F.char_length("label"))).otherwise(F.col("label")).alias("short"),
        (F.col("_cc").isNotNull() & ~fits).alias("mismatch"),
    )


def infer_scale(labels: DataFrame, named: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(variable, scale_type, min, max) from `labels(variable, code, label, kind, country_code)`.

    named: (pattern of a variable's name, scale type), for variables that are no answers and have no bounds.
    """
    answer = F.col("kind").isNull()
    open_ended = F.when(answer & F.rlike("label", F.lit(r"^\d+\+$")), F.col("code"))
    v = labels.groupBy("variable").agg(
        F.countDistinct(F.when(answer, F.col("code"))).alias("n"), F.min(F.when(answer, F.col("code"))).alias("lo"), F.max(F.when(answer, F.col("code"))).alias("hi"),
        F.max(open_ended).alias("top"), F.max(answer & F.col("country_code").isNotNull()).alias("by_country"),
    )
    n, lo, hi, top = (F.col(c) for c in ("n", "lo", "hi", "top"))
    codes = lambda low, high: (n == 2) & (lo == low) & (hi == high)
    rules = [("nominal", F.col("by_country")), ("count", top.isNotNull()), ("scale_0_10", codes(0, 10)), ("binary", codes(1, 2)), ("ordinal", (n >= 3) & lo.isin(0, 1) & (hi - lo + 1 == n)), ("nominal", n > 0), ("continuous", F.lit(True))]
    by_name = _first_rule([(F.lit(kind), F.rlike("variable", F.lit(pattern))) for pattern, kind in named] or [(F.lit(None).cast("string"), F.lit(False))])
    by_codes = _first_rule([(F.lit(kind), condition) for kind, condition in rules])
    counted = by_codes == "count"
    low = F.when(counted, F.when(lo == 0, F.lit(0))).otherwise(lo)
    return v.select("variable", F.coalesce(by_name, by_codes).alias("scale_type"), F.when(by_name.isNull(), low).alias("min"), F.when(by_name.isNull(), F.when(counted, top).otherwise(hi)).alias("max"))


def expand_scale_labels(labels: DataFrame, variables: DataFrame) -> DataFrame:
    """All codes 0-10 of 0-10 items, with empty labels where the catalog names only the ends."""
    full = variables.where("scale_type = 'scale_0_10'").select(F.col("variable").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("c"))
    return full.join(labels, (F.col("v") == F.col("variable")) & (F.col("c") == F.col("code")), "left").select(F.col("v").alias("variable"), F.col("c").alias("code"), F.coalesce("label", F.lit("")).alias("label"))


def catalog_coverage(columns: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, problem): columns without an entry and entries without a column."""
    a = columns.join(catalog, columns["name"] == catalog["name"], "left_anti").select("name", F.lit("no_entry").alias("problem"))
    return a.unionByName(catalog.join(columns, catalog["name"] == columns["name"], "left_anti").select("name", F.lit("no_column").alias("problem")))


def waves_of(columns: DataFrame) -> DataFrame:
    """(variable, waves) from column names with a wave suffix."""
    parts = columns.select(F.regexp_extract("name", r"^(.*)_(Y1|MY|Y2)$", 1).alias("variable"), F.regexp_extract("name", r"_(Y1|MY|Y2)$", 1).alias("wave")).where("wave <> ''")
    return parts.groupBy("variable").agg(F.array_join(F.sort_array(F.collect_set("wave")), ",").alias("waves"))


def breakdown_labels(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(variable, code, label) of observed codes: the short label, else the label, else the code itself."""
    ls = labels.select(F.col("variable").alias("_v"), F.col("code").alias("_c"), "label", "short_label")
    out = values.select("variable", "code").distinct().join(ls, (F.col("variable") == F.col("_v")) & (F.col("code") == F.col("_c")), "left")
    return out.select("variable", "code", F.coalesce("short_label", "label", F.col("code").cast("string")).alias("label"))


def answer_labels(labels: DataFrame, wave: str, country: int | None) -> DataFrame:
    """(variable, code, label): the most specific label wins, country before wave before general."""
    ok = labels.where((F.col("wave").isNull() | (F.col("wave") == wave)) & (F.col("country_code").isNull() | (F.col("country_code").eqNullSafe(F.lit(country)))))
    rank = F.col("country_code").isNotNull().cast("int") * 2 + F.col("wave").isNotNull().cast("int")
    return ok.groupBy("variable", "code").agg(F.max_by("label", rank).alias("label"))


def variable_search(variables: DataFrame, text: str, family: str | None = None) -> DataFrame:
    hit = F.lit(False)
    for c in ("name", "display_name", "wording"):
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(text.lower()))
    out = variables.where(F.coalesce(hit, F.lit(False)))
    return out.where(F.col("family") == family) if family else out


def variable_detail(variables: DataFrame, labels: DataFrame, coverage: DataFrame) -> DataFrame:
    """One nested row for each variable: labels in code order and missingness by wave."""
    ls = labels.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct("code", "label"))).alias("labels"))
    miss = coverage.groupBy("variable", "wave").agg(F.sum("n_present").alias("n_present"), F.sum("n_valid").alias("n_valid"))
    ms = miss.groupBy("variable").agg(F.sort_array(F.collect_list(F.struct("wave", "n_present", "n_valid"))).alias("missingness"))
    v = variables.withColumnRenamed("name", "variable")
    return v.join(ls, "variable", "left").join(ms, "variable", "left")


SERVABLE = ("scale_0_10", "ordinal", "nominal", "binary", "count")


def servable_outcomes(variables: DataFrame, derived: DataFrame) -> DataFrame:
    """(name, scale_type, default_stat) of what may be asked for: catalog items and derived scores."""
    ok = variables.where(F.col("scale_type").isin(*SERVABLE) & ~F.col("restricted") & ~F.col("is_country_specific")).select("name", "scale_type")
    stat = F.when(F.col("scale_type").isin("scale_0_10", "count", "score"), "mean").otherwise("proportion")
    return ok.unionByName(derived.select("name", "scale_type")).withColumn("default_stat", stat)


def candidate_predictors(variables: DataFrame, outcome: str, wave: str) -> DataFrame:
    """Ordered servable items asked at the wave, or at the midyear interview, that share no answers with the outcome.

    Those asked at midyear alone are marked by column midyear: their pairs with the wave take the panel weight of both.
    """
    mine = variables.where(F.col("name") == outcome).select(F.col("name").alias("_outcome"), F.explode("components").alias("_mine"))
    at_wave, at_midyear = F.array_contains("waves", wave), F.array_contains("waves", "MY")
    ordered = variables.where(F.col("scale_type").isin("scale_0_10", "ordinal", "binary", "count") & (at_wave | at_midyear) & (F.col("name") != outcome))
    sharing = ordered.select("name", F.explode("components").alias("_mine")).join(mine, "_mine").select("name").distinct()
    return ordered.join(sharing, "name", "left_anti").withColumn("midyear", ~at_wave)
