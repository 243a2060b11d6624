"""Intermediate tables in the folder that all executors share: they end lineage, and lost executors lose nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows of a few numbers that one task writes where a bound of all rows is known.
ROWS_A_FILE = 100_000
#: Rows that a join may broadcast, by way of the driver. Spark goes by the size of files, in which ids take little room.
MOST_SENT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder in local mode; an error on a cluster,
    whose executors could not read such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault("dir", tempfile.mkdtemp(prefix="graphspark-"))


def by_few(df: DataFrame, most: int) -> DataFrame:
    """df, which is known to have at most `most` rows, by as many tasks as those need, not one a partition of its shuffle."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, most // ROWS_A_FILE))


def keyed(df: DataFrame, rows: int) -> DataFrame:
    """df, one side of a join whose smaller side has about `rows` rows: where these are many, both are dealt by the key."""
    return df.hint("merge") if rows > MOST_SENT else df


def cut(df: DataFrame, name: str = "step", most: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Where df is known to have at most `most` rows, they are written by as many tasks as those need, not one a partition.
    The folders belong to the session's checkpoint folder and go with it: a result may be read as long as it is there."""
    spark = df.sparkSession
    if most is not None:
        df = by_few(df, most)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
