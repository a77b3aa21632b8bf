"""All queries of the library with their SQL twins."""

from __future__ import annotations

from .plans import bench, code, distill, ledger, mining, pages, retrieval, sections, usage
from .plans.registry import Query

FAMILIES = (usage.R, ledger.R, bench.R, distill.R, sections.R, mining.R, pages.R, code.R, retrieval.R)


def queries() -> dict[str, Query]:
    return {name: q for family in FAMILIES for name, q in family.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in FAMILIES for name, q in family.oracles.items()}
