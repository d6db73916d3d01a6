"""Helpers to assemble oracle SQL from named common table expressions and to
normalise its output the same way :func:`partcast.functions.present.present`
normalises Spark output."""

from __future__ import annotations

import functools
import os

from partcast.functions.present import BIG, DIGITS, SIG_DIGITS

_CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    _CTES[name] = (body.strip(), deps)


class SqlRef:
    """Oracle SQL whose CTEs are resolved when rendered, so catalog modules
    may register CTEs in any import order."""

    def __init__(self, body: str, names: tuple[str, ...]):
        self.body, self.names = body, names

    def render(self) -> str:
        return _build(self.body, *self.names)

    def __str__(self) -> str:
        return self.render()


def sql(body: str, *names: str) -> SqlRef:
    """``WITH`` clause holding ``names`` and everything they depend on, then ``body``."""
    return SqlRef(body, names)


def render(q) -> str:
    return q.render() if isinstance(q, SqlRef) else q


def _build(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS (\n{_CTES[n][0]}\n)" for n in order)
    return f"WITH {parts}\n{body.strip()}"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@functools.lru_cache(maxsize=4)
def _describe_con(tables_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(tables_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _wrap_col(name: str, typ: str) -> str:
    q = '"' + name.replace('"', '""') + '"'
    t = typ.upper()
    if t in ("DOUBLE", "FLOAT", "REAL") or t.startswith("DECIMAL"):
        r = f"(round(CAST({q} AS DOUBLE), {DIGITS}) + 0.0)"
        e = f"CAST('1e' || CAST(CAST(floor(log10(abs({r}))) AS BIGINT) AS VARCHAR) AS DOUBLE)"
        return (f"CASE WHEN abs({r}) >= {BIG} AND isfinite({r}) "
                f"THEN round({r} / {e}, {SIG_DIGITS - 1}) * {e} ELSE {r} END AS {q}")
    if t == "DATE":
        return f"strftime({q}, '%Y-%m-%d') AS {q}"
    if t.startswith("TIMESTAMP"):
        return f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}"
    if t in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT",
             "UINTEGER", "UBIGINT"):
        return f"CAST({q} AS BIGINT) AS {q}"
    return q


def normalise(query, tables_dir: str) -> str:
    """Wrap ``query`` so doubles are rounded, dates are ISO strings and integers
    are BIGINT.  Column types come from DuckDB's DESCRIBE (binding only, no
    execution) on the tables in ``tables_dir``."""
    query = render(query)
    rows = _describe_con(tables_dir).execute(f"DESCRIBE ({query})").fetchall()
    cols = ", ".join(_wrap_col(r[0], r[1]) for r in rows)
    return f"SELECT {cols} FROM (\n{query}\n) AS q"
