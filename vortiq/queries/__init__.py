"""The registered queries of the library itself: a function of (spark, sf_dir), and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import boundary, dynamics, fields, flow, handoff, joint, oracles, relational, sections, studies

PARTS = (flow, relational, boundary, fields, dynamics, sections, studies, handoff, joint)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql} | oracles.SQL
