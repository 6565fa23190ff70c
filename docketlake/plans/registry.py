"""Collects the queries of all families and their SQL statements."""

from __future__ import annotations

from collections.abc import Callable


def _same_rounding(sql: str) -> str:
    """Write round(x, n) so that it rounds like ``functions.text.rounded``: on ten decimals, half away from zero."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find("round(", j + 1)
        if j < 0:
            return "".join(out) + sql[i:]
        depth, quoted, comma, k = 1, False, -1, j + 6
        while depth:
            c = sql[k]
            quoted ^= c == "'"
            if not quoted:
                depth += (c in "([") - (c in ")]")
                comma = k if c == "," and depth == 1 else comma
            k += 1
        digits = sql[comma + 1:k - 1].strip()
        inner = _same_rounding(sql[j + 6:comma])
        body = f"CAST(round(CAST({inner} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)" if int(digits) < 10 else f"round({inner}, {digits})"
        out += [sql[i:j], body]
        i = k


QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame, with the SQL that gives the same rows."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _same_rounding(sql)
        return fn

    return add
