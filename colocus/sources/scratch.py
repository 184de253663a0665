"""Scratch tables in the shared checkpoint folder, which cut the lineage of what is used repeatedly."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_own: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the folder in spark.checkpoint.dir and reads it back.

    Only where that is unset, as in tests, a temporary folder takes its place, which goes when Python ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-scratch-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = _own[app]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
