"""Queries by name, and the SQL that each must agree with.

The data directory holds order and event tables, not matches, so each query runs its operator on a stand-in: a line
item is a player's line on a map (player l_suppkey, map l_orderkey, kills l_quantity, deaths l_linenumber, damage
l_extendedprice, season the year of l_shipdate, mode l_returnflag), an order is a series of two of 25 teams, an event
is an entry of a kill feed. The operators themselves take real match tables and are tested with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
