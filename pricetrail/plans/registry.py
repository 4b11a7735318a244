"""Query registry: a name, a Spark plan over a table folder, and oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricetrail.plans.views import VIEWS
from pricetrail.session import keep_compiled, use_utc

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the shared views a statement mentions, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS (\n{VIEWS[n].strip()}\n)" for n in needed)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


def register(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Decorator adding a plan, and its oracle where plain SQL can state it."""

    def add(plan: Plan) -> Plan:
        def run(spark: SparkSession, root: str) -> DataFrame:
            return plan(keep_compiled(use_utc(spark)), root)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return plan

    return add
