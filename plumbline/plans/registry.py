"""All queries of the package by name, and their SQL."""

from __future__ import annotations

from . import core, extra, policies, ranking, relations, search, stability  # noqa: F401  (importing registers)


def queries():
    return {name: core.query(name) for name in core.PLANS} | extra.QUERIES


def oracle_sql():
    return {name: core.oracle(name) for name in core.PLANS} | {name: core.rendered(sql, needs) for name, (needs, sql) in extra.SQL.items()}
