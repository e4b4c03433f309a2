"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode and an error on a cluster, whose executors would each write to their own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = getattr(spark, "_provisio_tables", None) or tempfile.mkdtemp(prefix="provisio-")
        spark._provisio_tables = where
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/provisio-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Jobs that a driver runs side by side; small ones leave most of a cluster idle.
SIDE_BY_SIDE = 4


def side_by_side(run: Callable, items: list) -> list:
    """run of each of the items, some at a time; the first error is raised when those begun have ended."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(run, items))


def written_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """written() of each table, under its name."""
    return dict(zip(tables, side_by_side(lambda x: written(x[1], x[0].lower()), list(tables.items())), strict=True))
