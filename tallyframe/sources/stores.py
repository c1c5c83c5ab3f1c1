"""Tables the library keeps: column profiles per dataset, and the log of forecast runs."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fixed
from tallyframe.operators.catalogue import dataset_fingerprint, identifier_count_metrics, metric_catalogue
from tallyframe.operators.profile import NameHints, profile_columns, rank_date_columns

RUN_KEYS = ("fingerprint", "metric_key", "granularity")


def write_profile_store(df: DataFrame, path: str, hints: NameHints = NameHints()) -> None:
    """Profile the table and replace its partition in the store, found by fingerprint.

    Other datasets' partitions stay untouched, and readers see the old or the new one as a whole.
    """
    key = dataset_fingerprint(df).select("fingerprint").withColumn("_one", F.lit(1))
    profiled = profile_columns(df, hints=hints).withColumn("_one", F.lit(1))
    stamped = profiled.join(F.broadcast(key), "_one").drop("_one").withColumns({
        "profiler_version": F.lit(fixed.PROFILER_VERSION), "catalogue_version": F.lit(fixed.CATALOGUE_VERSION),
    })
    # One row per column: one file per dataset.
    (stamped.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("fingerprint").parquet(path))


def read_profile_store(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """Stored profiles written by the current rules; older versions count as absent."""
    stored = spark.read.parquet(path).where(
        (F.col("profiler_version") == fixed.PROFILER_VERSION) & (F.col("catalogue_version") == fixed.CATALOGUE_VERSION)
    )
    return stored if fingerprint is None else stored.where(F.col("fingerprint") == fingerprint)


def stored_metrics(profiles: DataFrame) -> DataFrame:
    """Metric catalogue of one stored profile, identifier counts included."""
    dated = rank_date_columns(profiles).where("is_primary")
    counted = identifier_count_metrics(profiles, has_date_column=False).drop("forecastable")
    has_date = dated.agg((F.count(F.lit(1)) > 0).alias("has_date")).scalar()
    catalogue = metric_catalogue(profiles)
    return catalogue.withColumn("forecastable", F.col("forecastable") & has_date).unionByName(
        counted.withColumn("forecastable", has_date)
    )


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file whole, unless there is one of that name; false then. One of many writers succeeds."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.getUri().getScheme() == "file":  # a rename on a local disk would replace the other file
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(draft, False)
    done = files.rename(draft, target)
    if not done:
        files.delete(draft, False)
    return done


def append_runs(runs: DataFrame, path: str) -> int:
    """Append the rows of one forecast run; returns its place in the order of all runs.

    The rows go into a folder of their own, which a numbered commit file then names. Writers that meet take
    the next number, so none overwrites another's, and rows without a commit are not read.
    """
    spark = runs.sparkSession
    name = f"run-{uuid.uuid4().hex}"
    runs.write.parquet(f"{path}/runs/{name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    while True:
        taken = [status.getPath().getName() for status in files.listStatus(folder)]
        number = 1 + max((int(t) for t in taken if t.isdigit()), default=0)
        if _put_if_absent(spark, f"{path}/commits/{number:010d}", name):
            return number


def append_batch(batch: DataFrame, df: DataFrame, path: str) -> int:
    """Append what a batch of forecasts updated to the log, with the fingerprint and row count of its table."""
    stamp = dataset_fingerprint(df).withColumnRenamed("row_count", "rows")
    updated = batch.where("status = 'updated'").drop("status")
    return append_runs(updated.join(F.broadcast(stamp), F.lit(True)), path)


def read_runs(spark: SparkSession, path: str, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """All committed runs with their version: a key's first run has 1, its next 2, and so on."""
    commits = spark.read.text(f"{path}/commits").select(F.col("value").alias("_run"), F.col("_metadata.file_name").cast("bigint").alias("_commit"))
    rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/runs")
    named = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), "/(run-[0-9a-f]+)/[^/]*$", 1).alias("_run"))
    # a row a run of the log
    placed = named.join(F.broadcast(commits), "_run")
    order = Window.partitionBy(*keys).orderBy("_commit")
    return placed.withColumn("version", F.dense_rank().over(order).cast("bigint")).drop("_run", "_commit")
