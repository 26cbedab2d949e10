"""Session settings the library is tuned for."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Settings that change results or plans.  Cluster sizing (executors, memory,
#: shuffle partitions) stays with the submitter; AQE coalesces small shuffles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Plans are built from many small expressions; recording a Python stack for each one triples build time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Arbitrary stateful streaming needs the RocksDB provider.
    STATE_STORE: ROCKSDB,
}


def build_session(master: str | None = None, app: str = "obsgauge", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_rocksdb(spark: SparkSession) -> None:
    """The state store of arbitrary stateful streams, in sessions that were built elsewhere."""
    if spark.conf.get(STATE_STORE, "") != ROCKSDB:
        spark.conf.set(STATE_STORE, ROCKSDB)


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None)


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A handful of rows known to the program as a local relation.

    Its size is known while planning, so joins with it need neither a job nor
    a guess; ``createDataFrame`` on a list would scan an RDD instead.
    """
    schema = T.StructType.fromDDL(ddl)
    fields = [f.name for f in schema.fields]
    table = pa.Table.from_pylist([dict(zip(fields, r)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema)
