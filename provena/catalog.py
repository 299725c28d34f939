"""The graph engine's queries by name, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provena import registry
from provena.operators import answers, contracts, criticality, disputes, expansion, extraction, gaps, greedy, handlers, notes, patterns, policy, questions, rules, selection, templates, texts  # noqa: F401
from provena.plans import browse  # noqa: F401
from provena.plans.fixture import Graph, oracle
from provena.sources import bundles, leads, office, records, tables  # noqa: F401
from provena.streaming import flows  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.common_needs(Graph(spark, sf_dir), min_domains=2)


def queries() -> dict:
    return {n: (lambda spark, sf_dir, f=f: f(Graph(spark, sf_dir))) for n, f in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: oracle(s) for n, s in registry.ORACLES.items()}
