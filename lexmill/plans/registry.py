"""Names of queries, what runs them and the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans.inputs import table, with_inputs
from lexmill.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Tables of a data folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def kept(self, name: str) -> DataFrame:
        """A derived table that a query reads several times, computed once."""
        if name not in self._kept:
            self._kept[name] = cut(table(self.spark, self.sf_dir, name))
        return self._kept[name]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, computed once for a query, under a name that no table has."""
        if name not in self._kept:
            self._kept[name] = cut(make())
        return self._kept[name]


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of Tables under a name, with DuckDB SQL in which {x} stands for a table."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = with_inputs(oracle)
        return f

    return put
