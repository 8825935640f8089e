"""Rows that may not go on, with the reasons, beside those that may; found and counted in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in their order; a rule that is null counts as kept."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def split(rows: DataFrame, rules: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(rows that break no rule, the others with `reasons`, how many rows there are and break each rule).

    rules: a reason and the condition under which a row is rejected for it. The rows are read once: both outputs are written to
    path in one job, side by side, and an Observation takes the counts of `rows`, `rejected` and each reason meanwhile.
    """
    seen = Observation()
    found = rows.withColumn("reasons", reasons(rules)).withColumn("rejected", F.size("reasons") > 0)
    counts = [F.count_if(F.array_contains("reasons", name)).alias(f"reason {k}") for k, name in enumerate(rules)]
    found = found.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("rejected").alias("rejected"), *counts)
    found.write.partitionBy("rejected").parquet(path)
    both = rows.sparkSession.read.schema(found.schema).parquet(path)
    n = seen.get
    totals = {"rows": n["rows"], "rejected": n["rejected"]} | {name: n[f"reason {k}"] for k, name in enumerate(rules)}
    return both.where("NOT rejected").drop("reasons", "rejected"), both.where("rejected").drop("rejected"), totals


def analysis_rules(text: str = "text", version: str = "version_id") -> dict[str, Column]:
    """Why a document can't be analysed: it has no version, or its version no text."""
    none = F.col(version).isNull()
    return {"no current version": none, "version has no text": ~none & (F.coalesce(T.strip(F.col(text)), F.lit("")) == "")}


def failures(rejected: DataFrame, key: str) -> DataFrame:
    """key, status, error: a failure row for each rejected one."""
    return rejected.select(key, F.lit("FAILED").alias("status"), F.array_join("reasons", "; ").alias("error"))
