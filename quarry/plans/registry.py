"""Registry of the named queries run by the driver and the bench.

Each query is a function ``(spark, sf_dir) -> DataFrame`` built from the
library's operators over the driver's parquet tables; ``sql`` is the
DuckDB-runnable statement that must return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_all() -> None:
    """Import every module that registers queries."""
    from quarry.plans import (  # noqa: F401
        q_aggregates,
        q_extract,
        q_filters,
        q_joins,
        q_options,
        q_quality,
        q_sources,
        q_stats,
        q_streaming,
        q_text,
        q_transforms,
    )


def nullable_ints_as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Integer columns that can be null are compared as doubles on both sides
    (pandas has no common nullable-integer form for the two engines)."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle hygiene: summation order differs between engines)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])
