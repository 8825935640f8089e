"""Named queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where each costs more than reading it: a small file is one task, however long its rows take.
SPREAD_ROWS = 20_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """The driver's tables of one folder; rows(sql) runs a statement in which {name} stands for a table."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def folder(self, name: str) -> str:
        """A new folder under the one that the driver and all executors share (spark.checkpoint.dir)."""
        found = self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found:
            if not self.spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="spark-")  # one machine: tests
        return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"

    def spread(self, name: str, key: str) -> DataFrame:
        """A table dealt by key to all cores, or to more tasks if it has more than SPREAD_ROWS rows for each."""
        rows = table(self.spark, self.sf_dir, name)
        n = max(4 * self.spark.sparkContext.defaultParallelism, -(-rows.count() // SPREAD_ROWS))
        return rows.repartition(n, key)

    def rows(self, sql: str, **tables: DataFrame) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", sql))
        quoted = re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(quoted, **{n: tables[n] if n in tables else table(self.spark, self.sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The statement of Tables.rows() for a database that knows the tables by name."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def query(name: str, sql: str | None = None, **inputs: str):
    """Register f(tables) as a query. In sql, $x stands for the input statement x in parentheses."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            text = sql
            for k, v in inputs.items():
                text = text.replace(f"${k}", f"({plain(v)})")
            SQL[name] = text
        return f

    return add
