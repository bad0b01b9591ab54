"""Tables computed once for a version of their sources and then only read; people and answers side by side in buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import shared_dir


def _file(spark: SparkSession, path: str):
    """(file system, path) of the JVM, whatever the store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def source_version(job: str, *sources: DataFrame) -> str:
    """A digest of the job's name and of path, size and time of every file the sources read; no row is looked at."""
    lines = []
    for df in sources:
        for f in df.inputFiles():
            store, at = _file(df.sparkSession, f)
            status = store.getFileStatus(at)
            lines.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join([job, *sorted(lines)]).encode()).hexdigest()[:32]


def kept_table(spark: SparkSession, name: str, version: str, build: Callable[[], DataFrame], key: list[str]) -> DataFrame:
    """The table of that name and version in the shared folder: built and written at the first call, then only read.

    Rows are written in the order of the key, with a Bloom filter for each of its text columns, so that a lookup reads
    the row groups that hold its key.  Another version is another table; a write that did not end is written again.
    """
    path = f"{shared_dir(spark)}/kept/{name}-{version}"
    store, done = _file(spark, f"{path}/_SUCCESS")
    if not store.exists(done):
        rows = build()
        w = rows.repartitionByRange(*key).sortWithinPartitions(*key).write.mode("overwrite").option("compression", "zstd")
        for c in key:
            if dict(rows.dtypes)[c] == "string":
                w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        w.parquet(path)
    return spark.read.parquet(path)


class SurveyTables:
    """Answers and people in buckets by person: a question's slice, its people and another question's slice meet without a
    shuffle, and a slice reads only the files of its question and wave."""

    def __init__(self, long: DataFrame, people: DataFrame, version: str, buckets: int | None = None) -> None:
        self.spark = spark = long.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names = {k: f"survey_{k}_{version}_{buckets}" for k in ("answers", "people")}
        for kind, df, parts in (("answers", long, ("variable", "wave")), ("people", people, ())):
            if spark.catalog.tableExists(self.names[kind]):
                continue
            # dealt out as the buckets are, each task writes one file of a bucket
            w = df.repartition(buckets, "id").write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/tables/{self.names[kind]}")
            (w.partitionBy(*parts) if parts else w).bucketBy(buckets, "id").sortBy("id").saveAsTable(self.names[kind])

    @property
    def people(self) -> DataFrame:
        return self.spark.table(self.names["people"])

    def slice(self, variable: str, wave: str, to: str = "value") -> DataFrame:
        """(id, to): the answers to one question at one wave, missing ones as null."""
        return self.spark.table(self.names["answers"]).where((F.col("variable") == variable) & (F.col("wave") == wave)).select("id", F.col("value").alias(to))

    def frame(self, outcome: str, wave: str, breakdown: str | None = None) -> DataFrame:
        """People who were asked, with their answer as `value` and, as `breakdown`, their answer to another question."""
        if breakdown == outcome:
            raise ValueError("an outcome does not break down by itself")
        out = self.people.join(self.slice(outcome, wave), "id")
        return out.join(self.slice(breakdown, wave, "breakdown"), "id", "left") if breakdown else out
