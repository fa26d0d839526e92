"""All queries over the driver's tables, gathered from the modules of plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import answers, claims, composed, evaluation, events, law, parts, retrieval, routing, store, text

MODULES = [retrieval, routing, store, text, evaluation, answers, claims, events, law, parts, composed]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}
