"""The registry of queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL that must agree."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name, with its oracle."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; where that is unset, in local mode, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/query-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp()
