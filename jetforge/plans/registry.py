"""Named queries over the supplied tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUDGE = "3.1415926535"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns. A nudge far below the last digit, off any decimal grid, makes exact
    halves round the same way whatever the summation order."""
    nudge = float(f"{NUDGE}e-{digits + 3}")
    return df.select(*[(F.round(F.col(c) + nudge, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def check_sql(body: str, doubles: Sequence[str] = (), digits: int = 6) -> str:
    """The same rounding around a SQL statement."""
    nudge = f"{NUDGE}e-{digits + 3}"
    if not doubles:
        return body
    repl = ", ".join(f"round(CAST({c} AS DOUBLE) + {nudge}, {digits}) + 0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM ({body}) AS q"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = check_sql(sql, doubles, digits)
        return fn

    return add
