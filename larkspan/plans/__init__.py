"""Plans: registered queries over a folder of tables, with the SQL that checks them."""

from __future__ import annotations

from larkspan.plans import audit, catalogue, engineering, retrieval, rules, texts
from larkspan.plans.common import Query

MODULES = (retrieval, catalogue, texts, audit, rules, engineering)


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
