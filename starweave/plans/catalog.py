"""Registry of the library's own queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starweave.plans import clinical, derived, operator_queries, workflow

_ALL = (operator_queries.R, derived.R, workflow.R, clinical.R)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for r in _ALL for k, f in r.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _ALL for k, s in r.sql.items()}


def run(spark: SparkSession, folder: str, mode: str = "explain", names: list[str] | None = None) -> DataFrame:
    """Explain or execute registered queries: one row each with rows and seconds (execute) or the plan's length (explain)."""
    import time

    rows = []
    for name in names or list(queries()):
        began = time.time()
        try:
            df = queries()[name](spark, folder)
            n = df.count() if mode == "execute" else len(df._jdf.queryExecution().toString())
            rows.append((name, mode, "SUCCEEDED", n, time.time() - began, ""))
        except Exception as e:  # the report is the result
            rows.append((name, mode, "FAILED", 0, time.time() - began, str(e)[:200]))
    return spark.createDataFrame(rows, "query string, mode string, status string, n long, seconds double, message string")
