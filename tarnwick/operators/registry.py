"""name -> query, and name -> SQL that DuckDB can run for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..dialect.parser import Parser
from ..functions import json as json_functions
from ..session import prepared
from ..sources.files import parquet
from . import engine_queries, stream_queries
from .dialect_queries import QUERIES as DIALECT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def dialect_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepared(spark)
        json_functions.register(spark)
        for t in TABLES:
            if re.search(rf"\b{t}\b", text):
                parquet(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(Parser(text).query())

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: dialect_query(t) for k, (t, _) in DIALECT.items()} | engine_queries.QUERIES | stream_queries.QUERIES
ORACLE: dict[str, str] = {k: o or t for k, (t, o) in DIALECT.items()} | engine_queries.ORACLE | stream_queries.ORACLE
