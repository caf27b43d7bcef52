"""Folders that driver and executors share, and cutting the lineage of DataFrames that a loop builds upon."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str, str]] = []


def remove_at_end(spark: SparkSession, kind: str, name: str) -> None:
    """Remove a folder (``path``) or a managed table (``table``) when the application's Python ends."""
    _made.append((spark, kind, name))


@atexit.register
def _remove_made() -> None:
    for spark, kind, name in _made:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}") if kind == "table" else files.remove(spark, name)
        except Exception:  # the session may be gone at exit; the folder is the cluster's scratch space
            return


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; on a single machine a temporary folder serves where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    path = f"{folder.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    remove_at_end(spark, "path", path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again."""
    spark = df.sparkSession
    path = new_folder(spark, "loop")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
