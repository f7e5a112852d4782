"""The registered queries: a name, a DataFrame builder, and the SQL that must agree."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelwarrant.fixtures import FIXTURE_NEEDS, FIXTURE_SQL

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}

CTES: dict[str, str] = dict(FIXTURE_SQL)
NEEDS: dict[str, tuple[str, ...]] = dict(FIXTURE_NEEDS)


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    """Name a reusable piece of oracle SQL."""
    CTES[name] = body
    NEEDS[name] = needs


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, ()):
            visit(other)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def oracle(needs: tuple[str, ...], body: str, recursive: bool = False) -> str:
    parts = [f"{n} as materialized ({CTES[n]})" for n in _ordered(needs)]
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a query; `needs` names the oracle pieces that `sql` reads."""

    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            recursive = any("components" in n for n in _ordered(needs))
            ORACLES[name] = oracle(needs, sql, recursive)
        return fn

    return wrap
