"""EXPLAIN as rows, and the shape of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_lines(df: DataFrame) -> list[tuple[str, str]]:
    """(plan_type, plan): the optimized logical plan's lines, then the physical plan's. No job runs."""
    execution = df._jdf.queryExecution()
    logical, physical = execution.optimizedPlan().toString(), execution.executedPlan().toString()
    return [(kind, line) for kind, text in (("logical", logical), ("physical", physical)) for line in text.splitlines() if line.strip()]


def explain(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(plan_lines(df), "plan_type string, plan string")


def top_node(df: DataFrame) -> str:
    """Name of the analyzed plan's top node."""
    return df._jdf.queryExecution().analyzed().nodeName()


def enforce_limit(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows; a limit that the query ends in is replaced, not nested."""
    if top_node(df) == "GlobalLimit":
        plan = df._jdf.queryExecution().analyzed()
        inner = plan.child().child() if plan.child().nodeName() == "LocalLimit" else plan.child()
        jvm = df.sparkSession._jvm
        df = DataFrame(getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$").ofRows(df.sparkSession._jsparkSession, inner), df.sparkSession)
    return df.limit(n)
