"""What the operators of this subpackage share: table access, durable intermediate tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where it is unset and Spark runs on one machine.

    On a cluster each executor would write to a disk of its own, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    if found := (sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='panelwright-')}")
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage ends here, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """The name, with as many underscores behind it as set it apart from all columns (Spark does not tell cases apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(columns: list[str]) -> list[Column]:
    """Columns by their names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables from which nothing is read any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of `rows` rows at most in this session: texts are long, and Python workers keep what a batch took."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def runs(texts: list[str | None], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about `most` characters together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
