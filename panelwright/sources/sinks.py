"""Writing tables: upserts, write-once inserts, sorted panels, exports."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.operators.durable import remove, scratch_dir


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows, replaced by new ones of the same key; among new rows of a key the last by `order` wins."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
        new = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    else:
        new = settled(new, keys)
    return _without(old, new, keys).unionByName(new.select(*old.columns))


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose key is not among others'; NULL is a key like any other."""
    named = others.select(*(F.col(k).alias(f"_other_{i}") for i, k in enumerate(keys))).distinct()
    return rows.join(named, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_other_{i}")) for i, k in enumerate(keys))), "left_anti")


def settled(new: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: without an order the greatest of the other columns, so that a rerun gives the same row."""
    rest = [c for c in new.columns if c not in keys]
    if not rest:
        return new.dropDuplicates(keys)
    return new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best")).select(*(F.col(f"_best.{c}").alias(c) if c in rest else F.col(c) for c in new.columns))


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Replaces rows by key in the partitions that new rows touch, and no others; written aside first, because Spark cannot overwrite what it reads."""
    from panelwright.sources.readers import path_exists

    if path_exists(spark, path):
        touched = new.select(partition).distinct()
        old = spark.read.parquet(path).join(touched, partition, "left_semi")
        aside = scratch_dir(spark, "upsert")
        upserted(old.select(*new.columns), new, keys).write.partitionBy(partition).parquet(aside)
        rows = spark.read.parquet(aside).withColumn(partition, F.col(partition).cast(new.schema[partition].dataType))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        remove(spark, aside)
    else:
        settled(new, keys).write.partitionBy(partition).parquet(path)


def merge_batch(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], epoch: int, buckets: int = 16) -> None:
    """A batch of an update-mode stream into a table of one row a key: the batch's rows replace those of their keys, all others stay.

    Keys lie in `buckets` partitions, and only those that the batch touches are rewritten. A row remembers its batch, and
    a batch changes no row of its own or a later one, so a repeated batch changes nothing. Batch numbers are those of one
    checkpoint: a stream that starts anew needs a table of its own.
    """
    from panelwright.sources.readers import path_exists

    new = rows.withColumns({"_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"), "_epoch": F.lit(epoch).cast("long")})
    if path_exists(spark, path):
        new = _without(new, spark.read.parquet(path).where(F.col("_epoch") >= epoch), keys)
    if not new.isEmpty():
        upsert(spark, path, new, keys, "_bucket")


def absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not there yet, one for each key."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def insert_absent(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    from panelwright.sources.readers import path_exists

    rows = absent(spark.read.parquet(path), new, keys) if path_exists(spark, path) else new.dropDuplicates(keys)
    rows.write.mode("append").parquet(path)


def write_panel(df: DataFrame, path: str, period: str, entity: str) -> None:
    """Sorted by (period, entity) over the files and within each."""
    df.repartitionByRange(period, entity).sortWithinPartitions(period, entity).write.mode("overwrite").parquet(path)


def without_empty_columns(df: DataFrame) -> DataFrame:
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in df.columns)).first()
    return df.select(*(F.col(f"`{c}`") for c in df.columns if counts[c]))


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON text a row, missing values left out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "true"}).alias("json"))


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes within fields are doubled, and blanks at their ends are kept."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_payload(df: DataFrame, path: str, month: str) -> None:
    """A JSON payload for each row under its month; a rerun replaces the month's partition only."""
    rest = [c for c in df.columns if c != month]
    rows = df.select(month, F.to_json(F.struct(*rest)).alias("payload"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def save_models(models: dict, path: str, metadata: DataFrame | None = None) -> None:
    """Each model in a folder of its name, and a table of metadata beside them."""
    for name, model in models.items():
        model.write().overwrite().save(f"{path}/{name}")
    if metadata is not None:
        metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def load_models(spark: SparkSession, path: str, name: str = "test_month") -> tuple[dict, DataFrame]:
    """The models by name, and their metadata, whose column `name` holds the names (one row a model)."""
    from pyspark.ml import PipelineModel

    metadata = spark.read.parquet(f"{path}/metadata")
    return {r[0]: PipelineModel.load(f"{path}/{r[0]}") for r in metadata.select(name).collect()}, metadata


def write_notes(notes: DataFrame, path: str, section: str, name: str, text: str) -> None:
    """A file for each row, in a folder `section=value` for each section.

    Where the path lies on a disk, tasks write the files themselves, each under its own name (rows that share one are
    numbered), so a task that runs again writes the same files: Spark's writer starts processes for each file there, to
    set its permissions. Elsewhere Spark's writer has as many tasks.
    """
    spark = notes.sparkSession
    dealt = notes.repartition(spark.sparkContext.defaultParallelism, section, name).select(section, name, text)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        dealt.drop(name).write.option("maxRecordsPerFile", 1).partitionBy(section).text(path)
        return
    root = unquote(urlparse(path).path)
    os.makedirs(root, exist_ok=True)

    def write(rows: Iterator) -> None:
        last, n = None, 0
        for key, title, value in rows:
            n, last = n + 1 if (key, title) == last else 0, (key, title)
            folder = os.path.join(root, f"{section}={'__HIVE_DEFAULT_PARTITION__' if key is None else quote(str(key), safe=' ')}")
            os.makedirs(folder, exist_ok=True)
            with open(os.path.join(folder, f"{quote(str(title), safe=' ')}{f'~{n}' if n else ''}.txt"), "w", encoding="utf-8", newline="") as f:
                f.write(f"{value or ''}\n")

    dealt.sortWithinPartitions(section, name, text).foreachPartition(write)
