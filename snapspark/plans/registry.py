"""Named queries: a Spark plan over the archive tables and, where SQL can say it, the same answer for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..domain import Archive, oracle

Plan = Callable[[Archive], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: dict[str, str] | None = None):
    """Register a plan; `tables` are extra CTEs the SQL may name with `$`."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            ORACLES[name] = oracle(sql, tables)
        return plan

    return register


def _flat(df: DataFrame) -> DataFrame:
    """Booleans as 0 / 1 so that results compare as plain numbers."""
    return df.select(
        *[F.col(f"`{f.name}`").cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`")
          for f in df.schema.fields]
    )


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _flat(plan(Archive(spark, sf_dir)))

        return run

    return {name: bind(plan) for name, plan in PLANS.items()}
