"""A store of text chunks by collection: each text once, with its vector and metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators.durable import remove, saved
from panelwright.operators.text import embedded, hashed_terms
from panelwright.sources.readers import path_exists

BUCKETS = 16
COLUMNS = "id string, text string, metadata string, embedding array<double>, collection string, bucket int"


def collection_of(source: Column, collections: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(x for k, v in collections.items() for x in (F.lit(k), F.lit(v))))[source], F.lit(default))


def add_chunks(spark: SparkSession, path: str, chunks: DataFrame, collections: dict[str, str], default: str = "other", encoder: Callable = hashed_terms) -> DataFrame:
    """Adds chunks(source, text, metadata) to the store and gives (collection, added).

    A chunk goes to the collection of its source; its id is the digest of its text, and a text that the collection holds
    already, or that occurs again among the new ones, is not added (of these the least metadata stays). Files lie by
    collection and bucket of the id, so a lookup reads ids of the buckets that new chunks fall into and no others. Only
    what is new is embedded. NULL texts are left out.
    """
    named = chunks.where("text is not null").select(F.sha2("text", 256).alias("id"), "text", "metadata", collection_of(F.col("source"), collections, default).alias("collection"))
    new = named.groupBy("collection", "id").agg(F.first("text").alias("text"), F.min("metadata").alias("metadata")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    new, new_path = saved(new)
    if path_exists(spark, path):
        touched = new.select("collection", "bucket").distinct()
        held = stored_chunks(spark, path).select("collection", "bucket", "id").join(touched, ["collection", "bucket"], "left_semi")
        new = new.join(held, ["collection", "bucket", "id"], "left_anti")
    before = counts(spark, path)
    columns = [c.split()[0] for c in COLUMNS.split(", ")]
    # A few files for each folder, and not one from each task.
    embedded(new, "text", encoder=encoder).select(*columns).hint("rebalance", "collection", "bucket").write.mode("append").partitionBy("collection", "bucket").parquet(path)
    remove(spark, new_path)
    after = counts(spark, path).join(before.withColumnRenamed("n", "old"), "collection", "left")
    return after.select("collection", (F.col("n") - F.coalesce("old", F.lit(0))).alias("added"))


def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(collection, n) as of now: a row for each collection."""
    told = stored_chunks(spark, path).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(told.collect(), told.schema)
