"""Intermediate tables in the shared folder, for results that several branches of a job use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below ``spark.checkpoint.dir``, which all executors share, and read back.

    A local session without the setting gets a temporary folder; on a cluster without it the plan stays as it is and is computed again
    by each use. Tables stay until the folder is cleared.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            return df
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
