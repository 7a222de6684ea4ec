"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

from skeinworks.plans import further, parity, problems
from skeinworks.plans.parity import flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries():
    return {**parity.QUERIES, **problems.QUERIES, **further.QUERIES}


def oracle_sql():
    return {**parity.ORACLE, **problems.ORACLE, **further.ORACLE}
