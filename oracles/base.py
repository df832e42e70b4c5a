"""Common table expressions of the checks; a query gets the ones it names, directly or not."""

from __future__ import annotations

import re

from assayframe.adapters import DUCK, VIEWS, view_sql, works_sql

CTES: dict[str, str] = {f"v_{name}": view_sql(name, DUCK) for name in VIEWS}
CTES["v_works"] = works_sql(DUCK)
RECURSIVE: set[str] = set()


def cte(name: str, sql: str, recursive: bool = False) -> None:
    CTES[name] = sql
    if recursive:
        RECURSIVE.add(name)


def query(body: str) -> str:
    """``body`` with a WITH list of every CTE it needs, in dependency order."""
    order: list[str] = []

    def visit(sql: str, own: str = "") -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", re.sub(r"'(?:[^']|'')*'", "''", sql))):
            if word in CTES and word != own and word not in order:
                visit(CTES[word], word)
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    head = "with recursive " if any(n in RECURSIVE for n in order) else "with "
    return head + ",\n".join(f"{n} as materialized ({CTES[n]})" if n not in RECURSIVE else f"{n} as ({CTES[n]})"
                             for n in order) + "\n" + body


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
