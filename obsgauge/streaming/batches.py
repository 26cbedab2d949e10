"""Tables that a stream writes batch by batch: one numbered folder a batch, whole or not there.

A batch that is run again after a failure writes its own folder again, so
nothing is lost or doubled.  Spark leaves ``_SUCCESS`` in a folder as its last step; a folder
without it does not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_batch(df: DataFrame, path: str, number: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that are whole, in order."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found or ())


def read_batches(spark: SparkSession, path: str, schema, numbers: list[int] | None = None) -> DataFrame:
    """Rows of the finished batches (or those given) with their ``batch``; no rows if there is none."""
    numbers = finished(spark, path) if numbers is None else numbers
    if not numbers:
        return spark.createDataFrame([], schema).selectExpr("*", "cast(null as int) as batch")
    root = path.rstrip("/")
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/batch={n}" for n in numbers])


def drop_batches(spark: SparkSession, path: str, keep: int) -> None:
    """Leave the newest ``keep`` finished batches, so that readers of the last ones can end."""
    for number in finished(spark, path)[:-keep]:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={number}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
