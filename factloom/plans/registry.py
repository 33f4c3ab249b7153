"""Registered queries: a plan takes the engine tables and returns a DataFrame; its oracle is SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.sources import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(plan: Callable[[adapters.Tables], DataFrame]):
        QUERIES[plan.__name__] = lambda spark, sf_dir: plan(adapters.Tables(spark, sf_dir))
        if oracle:
            ORACLES[plan.__name__] = adapters.oracle(oracle)
        return plan

    return add
