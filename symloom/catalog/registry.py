"""Registration of queries and of their SQL, with the shared view definitions spelled in."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symloom.catalog.views import SQL_VIEWS, Views
from symloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_VIEW = re.compile(r"@(v_\w+)")


def _with_views(sql: str) -> str:
    """Replace each ``@v_name`` item of the WITH list by the definition, after those it needs."""
    done: list[str] = []

    def need(name: str) -> None:
        if name in done:
            return
        for inner in SQL_VIEWS[name][0]:
            need(inner)
        done.append(name)

    def spell(match: re.Match) -> str:
        before = len(done)
        need(match.group(1))
        return ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in done[before:])

    return _VIEW.sub(spell, sql)


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(views) -> DataFrame`` under its own name; ``sql`` is the independent answer."""

    def register(fn: Callable[[Views], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(configure(spark), sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = _with_views(sql).strip()
        return fn

    return register
