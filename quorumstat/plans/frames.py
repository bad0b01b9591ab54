"""The survey roles of the driver's tables: Spark frames and the same frames in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def design_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as answers: nations nest in regions as strata in countries, customers are sampling units."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus")
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey").join(read(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    y = F.round(F.col("l_discount") * 100).cast("int")
    line = F.col("l_linenumber").cast("int")
    return j.select(
        F.col("n_regionkey").cast("int").alias("country_code"), F.col("c_nationkey").cast("int").alias("strata"), F.col("o_custkey").alias("psu"), F.col("l_quantity").alias("w"),
        F.when(line != 7, y).alias("y"), F.round(F.col("l_tax") * 100).cast("int").alias("item2"), line.alias("item3"), F.least(F.lit(10), y + line).alias("item4"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("nominal"), (F.col("l_linestatus") == "F").cast("int").alias("bin"),
        (F.col("l_discount") * 100).alias("score"),
    )


DESIGN_SQL = """SELECT CAST(n_regionkey AS INTEGER) AS country_code, CAST(c_nationkey AS INTEGER) AS strata, o_custkey AS psu, l_quantity AS w,
  CASE WHEN l_linenumber <> 7 THEN CAST(round(l_discount * 100) AS INTEGER) END AS y, CAST(round(l_tax * 100) AS INTEGER) AS item2,
  CAST(l_linenumber AS INTEGER) AS item3, least(10, CAST(round(l_discount * 100) AS INTEGER) + CAST(l_linenumber AS INTEGER)) AS item4,
  CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS nominal, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS bin,
  l_discount * 100 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def supplier_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by supplier: many strata with a single sampling unit."""
    li = read(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount")
    s = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").cast("int").alias("strata"), F.col("l_suppkey").alias("psu"), F.col("l_quantity").alias("w"), F.round(F.col("l_discount") * 100).cast("int").alias("y")
    )


SUPPLIER_SQL = """SELECT CAST(s_nationkey AS INTEGER) AS strata, l_suppkey AS psu, l_quantity AS w, CAST(round(l_discount * 100) AS INTEGER) AS y
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def panel_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Customers over three waves: the most urgent priority of their orders of 1996, 1997 and 1998."""
    o = read(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("yr"), F.substring("o_orderpriority", 1, 1).cast("int").alias("p")).where("yr in (1996, 1997, 1998)")
    v = o.groupBy("o_custkey").agg(*[F.min(F.when(F.col("yr") == y, F.col("p"))).alias(n) for y, n in ((1996, "y1"), (1997, "my"), (1998, "y2"))])
    c = read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(read(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    j = c.join(v, key == F.col("o_custkey"), "left")
    w = lambda k: (F.lit(k) + key % 7).cast("double")
    state = F.when(F.col("n_regionkey") == 1, F.concat(F.lit("S"), (key % 4).cast("string")))
    return j.select(
        key.alias("id"), F.col("n_regionkey").cast("int").alias("country_code"), F.col("n_regionkey").cast("int").alias("strata"), F.col("c_nationkey").cast("int").alias("psu"), "y1", "my", "y2",
        F.col("y2").isNotNull().alias("retained_y2"), F.col("my").isNotNull().alias("has_midyear"), F.when(F.col("my").isNotNull(), (1 + key % 2).cast("int")).alias("midyear_type"),
        *[w(k).alias(f"w_{s}") for k, s in enumerate(("c1", "c2", "l2", "r2", "l1m", "l1m2"), 2)], *[w(k).alias(f"w_state_{s}") for k, s in enumerate(("c1", "c2", "l2", "r2", "l1m", "l1m2"), 3)],
        *[w(k).alias(f"w_state_adj_{s}") for k, s in enumerate(("c2", "l2", "r2", "l1m", "l1m2"), 4)], state.alias("state"), F.when(key % 5 != 0, state).alias("state_y2"),
        (18 + key % 82).cast("int").alias("age"), (key % 9 * 100 + key % 13).cast("int").alias("income_code"), F.lit("S0_S1_S2").alias("state_group"),
    )


_W = [(k, f"w_{s}") for k, s in enumerate(("c1", "c2", "l2", "r2", "l1m", "l1m2"), 2)]
_W += [(k, f"w_state_{s}") for k, s in enumerate(("c1", "c2", "l2", "r2", "l1m", "l1m2"), 3)]
_W += [(k, f"w_state_adj_{s}") for k, s in enumerate(("c2", "l2", "r2", "l1m", "l1m2"), 4)]
PANEL_SQL = f"""SELECT c_custkey AS id, CAST(n_regionkey AS INTEGER) AS country_code, CAST(n_regionkey AS INTEGER) AS strata, CAST(c_nationkey AS INTEGER) AS psu, y1, my, y2,
  y2 IS NOT NULL AS retained_y2, my IS NOT NULL AS has_midyear, CASE WHEN my IS NOT NULL THEN CAST(1 + c_custkey % 2 AS INTEGER) END AS midyear_type,
  {', '.join(f'CAST({k} + c_custkey % 7 AS DOUBLE) AS {n}' for k, n in _W)},
  CASE WHEN n_regionkey = 1 THEN concat('S', CAST(c_custkey % 4 AS VARCHAR)) END AS state, CASE WHEN n_regionkey = 1 AND c_custkey % 5 <> 0 THEN concat('S', CAST(c_custkey % 4 AS VARCHAR)) END AS state_y2,
  CAST(18 + c_custkey % 82 AS INTEGER) AS age, CAST(c_custkey % 9 * 100 + c_custkey % 13 AS INTEGER) AS income_code, 'S0_S1_S2' AS state_group
  FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey,
    min(CASE WHEN year(o_orderdate) = 1996 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END) AS y1, min(CASE WHEN year(o_orderdate) = 1997 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END) AS my,
    min(CASE WHEN year(o_orderdate) = 1998 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END) AS y2 FROM orders GROUP BY o_custkey) v ON c_custkey = o_custkey"""


def long_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Events as long answers; the value 10 is the sentinel of a refusal."""
    e = read(spark, sf, "events")
    d = F.dayofmonth("ts")
    wave = F.when(d <= 10, "Y1").when(d <= 20, "MY").otherwise("Y2")
    v = F.least(F.lit(10), F.floor(F.col("value") / 30)).cast("int")
    g = e.select(F.col("user_id").alias("id"), wave.alias("wave"), F.col("event_type").alias("variable"), v.alias("v")).groupBy("id", "wave", "variable").agg(F.max("v").alias("raw"))
    return g.select("id", "wave", "variable", F.when(F.col("raw") != 10, F.col("raw")).alias("value"), F.when(F.col("raw") == 10, "refused").alias("nonresponse"))


LONG_SQL = """SELECT id, wave, variable, CASE WHEN raw <> 10 THEN raw END AS value, CASE WHEN raw = 10 THEN 'refused' END AS nonresponse FROM (
  SELECT user_id AS id, CASE WHEN day(ts) <= 10 THEN 'Y1' WHEN day(ts) <= 20 THEN 'MY' ELSE 'Y2' END AS wave, event_type AS variable,
    max(CAST(floor(least(10, floor(value / 30))) AS INTEGER)) AS raw FROM events GROUP BY 1, 2, 3) q"""


def people_frame(spark: SparkSession, sf: str) -> DataFrame:
    """A respondent for each user of the events."""
    return read(spark, sf, "events").select(F.col("user_id").alias("id")).distinct().select("id", (F.col("id") % 5).cast("int").alias("country_code"), (F.col("id") % 6 + 1).cast("double").alias("w"))


PEOPLE_SQL = "SELECT DISTINCT user_id AS id, CAST(user_id % 5 AS INTEGER) AS country_code, CAST(user_id % 6 + 1 AS DOUBLE) AS w FROM events"


_PANEL_WEIGHTS = ("w_c1", "w_c2", "w_l1m", "w_l1m2")


def panelists_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The same people with the design, flags, weights and demographics of a panel."""
    i = F.col("id")
    p = people_frame(spark, sf).drop("w")
    return p.withColumns(
        {
            "strata": (i % 10).cast("int"), "psu": (i % 10 * 10 + i % 7).cast("int"), "retained_y2": i % 3 != 0, "has_midyear": i % 2 == 0, "midyear_type": F.when(i % 2 == 0, (1 + i % 4 / 2).cast("int")),
            **{w: (k + i % 5).cast("double") for k, w in enumerate(_PANEL_WEIGHTS, 1)}, "age_band": F.when(i % 11 != 0, F.concat(F.lit("a"), (i % 4).cast("string"))), "income_quintile": (1 + i % 5).cast("int"),
        }
    )


PANELISTS_SQL = f"""SELECT id, country_code, CAST(id % 10 AS INTEGER) AS strata, CAST(id % 10 * 10 + id % 7 AS INTEGER) AS psu, id % 3 <> 0 AS retained_y2, id % 2 = 0 AS has_midyear,
  {', '.join(f'CAST({k} + id % 5 AS DOUBLE) AS {w}' for k, w in enumerate(_PANEL_WEIGHTS, 1))}, CASE WHEN id % 11 <> 0 THEN concat('a', CAST(id % 4 AS VARCHAR)) END AS age_band, CAST(1 + id % 5 AS INTEGER) AS income_quintile
  FROM ({PEOPLE_SQL}) p"""


def label_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: a binary outcome, a graded predictor and a control."""
    d = read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    j = d.join(read(spark, sf, "labels"), "doc_id")
    return j.select(
        F.col("lang").alias("strata"), F.col("source").alias("psu"), (1 + F.col("doc_id") % 5).cast("double").alias("w"), "quality", "toxic", F.least(F.lit(10), F.floor(F.col("n_chars") / 1000)).cast("int").alias("x"), "lang"
    )


LABEL_SQL = """SELECT lang AS strata, source AS psu, CAST(1 + doc_id % 5 AS DOUBLE) AS w, quality, toxic, CAST(least(10, floor(n_chars / 1000)) AS INTEGER) AS x, lang
  FROM documents JOIN labels USING (doc_id)"""


def values_sql(rows: list[tuple], names: list[str]) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(names)}))"


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
