"""Helpers of the registered queries: rounding on both sides, and SQL for the agreement measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

PLACES = 9


def rounded(df: DataFrame, *skip: str) -> DataFrame:
    """All double columns to nine places, so that the order of additions does not show."""
    return df.select(*(F.round(F.col(f"`{c}`"), PLACES).alias(c) if t == "double" and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes))


def r(expression: str, name: str) -> str:
    return f"round({expression}, {PLACES}) AS {name}"


def dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def kappa_cte(name: str, source: str, keys: Sequence[str]) -> str:
    """CTEs ending in ``name``: keys, n, accuracy, qwk on observed labels of (keys, y, p) rows."""
    k = ", ".join(keys)
    using = f"USING ({', '.join([*keys])})"
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    return f"""
        {name}_v AS (SELECT {k}, y, p FROM {source} WHERE y IS NOT NULL AND p IS NOT NULL),
        {name}_l AS (SELECT {k}, v, CAST(row_number() OVER (PARTITION BY {k} ORDER BY v) AS DOUBLE) AS c FROM (SELECT {k}, y AS v FROM {name}_v UNION SELECT {k}, p FROM {name}_v)),
        {name}_c AS (SELECT {', '.join('s.' + x for x in keys)}, a.c AS x, b.c AS z FROM {name}_v s JOIN {name}_l a ON {on('s', 'a')} AND s.y = a.v JOIN {name}_l b ON {on('s', 'b')} AND s.p = b.v),
        {name} AS (SELECT {k}, count(*) AS n, avg(CASE WHEN x = z THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy,
            CASE WHEN min(x) = max(x) AND min(z) = max(z) THEN CASE WHEN min(x) = min(z) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
            ELSE 1 - count(*) * sum((x - z) * (x - z)) / nullif(count(*) * sum(x * x) + count(*) * sum(z * z) - 2 * sum(x) * sum(z), 0) END AS qwk FROM {name}_c GROUP BY {k})"""


def tau_cte(name: str, source: str, keys: Sequence[str]) -> str:
    """CTEs ending in ``name``: keys, tau_b, from pairs of cells."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    ka = ", ".join(f"a.{x} AS {x}" for x in keys)
    return f"""
        {name}_n AS (SELECT {k}, y, p, CAST(count(*) AS DOUBLE) AS n FROM {source} WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY {k}, y, p),
        {name} AS (SELECT {k}, sum(w * sy * sp) / nullif(sqrt(sum(w * abs(sy)) * sum(w * abs(sp))), 0) AS tau_b
            FROM (SELECT {ka}, a.n * b.n AS w, sign(a.y - b.y) AS sy, sign(a.p - b.p) AS sp FROM {name}_n a JOIN {name}_n b ON {on}) GROUP BY {k})"""
