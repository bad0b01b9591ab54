"""Reading raw files and writing tables and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column as trimmed text; blanks are null."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return blank_to_null(raw)


def blank_to_null(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])


#: Types a catalog may name for a column.
CASTS = {"int16": "smallint", "int32": "int", "int64": "bigint", "double": "double", "string": "string"}


def cast_by_catalog(raw: DataFrame, types: dict[str, str], floored: frozenset[str] = frozenset()) -> DataFrame:
    """Casts text by catalog type; an unknown column is an error now, a bad cell one when read."""
    unknown = [c for c in raw.columns if c not in types]
    if unknown:
        raise ValueError(f"columns without a catalog type: {unknown}")

    def one(c: str):
        if types[c] == "date":
            return F.to_date(F.col(c), "M/d/yyyy").alias(c)
        value = F.floor(F.col(c).cast("double")).cast(CASTS[types[c]]) if c in floored else F.col(c).cast(CASTS[types[c]])
        return value.alias(c)

    return raw.select(*[one(c) for c in raw.columns])


def cast_with_quarantine(raw: DataFrame, types: dict[str, str], floored: frozenset[str] = frozenset(), bad: str = "_bad") -> DataFrame:
    """Casts text by catalog type; a cell that does not fit its type is null there and listed, as it stood, in the array
    column `bad` of (column, value).  One pass; `typed_rows` and `bad_cells` read the two sides."""
    unknown = [c for c in raw.columns if c not in types]
    if unknown:
        raise ValueError(f"columns without a catalog type: {unknown}")
    if bad in raw.columns:
        raise ValueError(f"{bad} is a column of the file")

    def one(c: str) -> Column:
        text = F.col(f"`{c}`")
        if types[c] == "date":
            return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")
        return F.floor(text.try_cast("double")).try_cast(CASTS[types[c]]) if c in floored else text.try_cast(CASTS[types[c]])

    cells = [F.when(F.col(f"`{c}`").isNotNull() & one(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"))) for c in raw.columns]
    return raw.select(*[one(c).alias(c) for c in raw.columns], F.array_compact(F.array(*cells)).alias(bad))


def typed_rows(parsed: DataFrame, bad: str = "_bad") -> DataFrame:
    return parsed.drop(bad)


def bad_cells(parsed: DataFrame, where: list[str], bad: str = "_bad") -> DataFrame:
    """(where..., column, value): the quarantined cells with the columns that tell their row."""
    return parsed.where(F.size(bad) > 0).select(*where, F.inline(bad))


def fractional_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): cells that are no whole numbers, in one pass."""
    one = df.agg(*[F.coalesce(F.sum((F.col(c).cast("double") != F.floor(F.col(c).cast("double"))).cast("long")), F.lit(0)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])))


def compare_shared_columns(a: DataFrame, b: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(column, n_different) over shared ids, null-safe."""
    left, right = a.select(id_col, *[F.col(c).alias(f"a_{c}") for c in columns]), b.select(id_col, *[F.col(c).alias(f"b_{c}") for c in columns])
    one = left.join(right, id_col).agg(*[F.coalesce(F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long")), F.lit(0)).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_different")) for c in columns])))


def key_containment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): keys of each side that the other lacks."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return only(a, b, "only_a").unionByName(only(b, a, "only_b"))


def scan_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_parquet(df: DataFrame, path: str, key: list[str], partition_by: tuple[str, ...] = ()) -> None:
    """Compressed Parquet in the order of the whole key."""
    w = df.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def catalog_tables(tables: dict[str, DataFrame], long: str = "responses_long", variables: str = "variables") -> None:
    """Registers the tables as views, and responses_oriented, in which more is always better."""
    from ..operators.reshape import orient

    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if long in tables and variables in tables:
        orient(tables[long], tables[variables]).createOrReplaceTempView("responses_oriented")


def static_views(estimates: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, n_rows, body): one JSON document for each view, all views in one job."""
    rows = F.sort_array(F.collect_list(F.struct(*fields)))
    g = estimates.groupBy(*keys).agg(rows.alias("rows"))
    return g.select(*keys, F.size("rows").cast("long").alias("n_rows"), F.to_json(F.struct(F.struct(*keys).alias("meta"), "rows")).alias("body"))


def export_static_views(estimates: DataFrame, path: str, keys: list[str], fields: list[str]) -> DataFrame:
    """Writes the documents partitioned by key and gives their index."""
    views = static_views(estimates, keys, fields)
    views.select(*keys, F.col("body").alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)
    return views.drop("body")


def labelled(rows: DataFrame, labels: dict[str, DataFrame]) -> DataFrame:
    """Each code column followed by its label column."""
    out = rows
    for c, table in labels.items():
        t = table.select(F.col("code").alias(f"_{c}"), F.col("label").alias(f"{c}_label"))
        out = out.join(t, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    order = [x for c in rows.columns for x in ((c, f"{c}_label") if c in labels else (c,))]
    return out.select(*order)


def export_csv_labelled(rows: DataFrame, labels: dict[str, DataFrame], path: str) -> None:
    labelled(rows, labels).write.mode("overwrite").option("header", True).csv(path)


def table_manifest(tables: dict[str, DataFrame], job_version: str = "1") -> DataFrame:
    """(table_name, rows, fingerprint, data_version): the fingerprint does not depend on the order of rows; the data
    version is a digest of all fingerprints and of the version of the job."""
    parts = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _versioned(out, job_version)


def _versioned(tables: DataFrame, head: str) -> DataFrame:
    """`tables(table_name, rows, fingerprint)`, a row for each table, with the digest of all of them."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("table_name", "rows", "fingerprint"))), lambda r: F.concat_ws(":", r["table_name"], r["rows"], r["fingerprint"]))
    version = tables.agg(F.sha2(F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n")), 256).alias("data_version"))
    return tables.join(version, F.lit(True))  # one row


def file_manifest(tables: dict[str, DataFrame], previous: DataFrame | None = None) -> DataFrame:
    """(table_name, file, size, modified, rows, fingerprint, reread) for every file of Parquet `tables`.

    A fingerprint is a sum of row hashes, so files add up to their table in any order.  Files that stand in `previous`
    with the same size and time keep its numbers, and only the others are read.
    """
    parts = []
    for name, df in tables.items():
        spark = df.sparkSession
        found = []
        for f in df.inputFiles():
            at = spark._jvm.org.apache.hadoop.fs.Path(f)
            status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
            found.append((name, f, status.getLen(), status.getModificationTime()))
        files = spark.createDataFrame(found, "table_name string, file string, size long, modified long")
        old = previous.where(F.col("table_name") == name).select("file", "size", "modified", "rows", "fingerprint") if previous is not None else None
        same = files.join(old, ["file", "size", "modified"]).select(*files.columns, "rows", "fingerprint", F.lit(False).alias("reread")) if old is not None else None
        known = {r["file"] for r in same.select("file").collect()} if same is not None else set()  # names of files, as the driver lists them
        new = [f for _, f, _, _ in found if f not in known]
        if new:
            rows = spark.read.schema(df.schema).parquet(*new)
            sums = rows.withColumn("_file", F.input_file_name()).groupBy("_file").agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("fingerprint"))
            fresh = files.where(F.col("file").isin(new)).join(sums, F.col("file") == F.col("_file"), "left")
            parts.append(fresh.select(*files.columns, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fingerprint", F.lit("0")).alias("fingerprint"), F.lit(True).alias("reread")))
        if known:
            parts.append(same)
    return reduce(DataFrame.unionByName, parts)


def next_version(files: DataFrame, job_version: str = "1", before: str = "") -> DataFrame:
    """(table_name, rows, fingerprint, data_version) of a file manifest.  The version is a digest of the version before it,
    of the job's and of all tables' fingerprints; with no change of rows it is that of the same chain."""
    tables = files.groupBy("table_name").agg(F.sum("rows").alias("rows"), F.sum(F.col("fingerprint").cast("decimal(38,0)")).cast("string").alias("fingerprint"))
    return _versioned(tables, f"{before}\n{job_version}" if before else job_version)
