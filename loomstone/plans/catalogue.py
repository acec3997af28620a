"""Every registered query of the library, by name."""

from __future__ import annotations

from loomstone.plans import guards, operations, questions, records, retrieval, selection, streams, study, texts
from loomstone.plans.shared import Query

AREAS = (retrieval.area, texts.area, study.area, operations.area, guards.area, records.area, questions.area, selection.area, streams.area)


def queries() -> dict[str, Query]:
    return {name: query for area in AREAS for name, query in area.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for area in AREAS for name, text in area.oracles.items()}
