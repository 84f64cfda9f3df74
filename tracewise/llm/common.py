"""Shared pieces of the operators: shipping task code, stored tables, column care."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewise.session import checkpoint_dir


#: Bytes of one Arrow batch to a Python worker; rows alone are no bound where texts are long.
ARROW_BATCH = 8 << 20
_ARROW_BYTES, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship_by_value() -> None:
    """Let Python workers run this subpackage's functions without having it installed, on batches of bounded size.

    A session that sets its own size of batches keeps it.
    """
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules["tracewise.llm"])
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(_ARROW_BYTES).rstrip("b") == str(_ARROW_DEFAULT):
        spark.conf.set(_ARROW_BYTES, str(ARROW_BATCH))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads the files.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def extended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The schema of ``df`` with more columns; a clash is the caller's error."""
    clash = {f.name.lower() for f in df.schema.fields} & {n.lower() for n, _ in fields}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return T.StructType(list(_nullable(df.schema).fields) + [T.StructField(n, t, True) for n, t in fields])
