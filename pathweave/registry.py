"""All queries of the library and their SQL."""

from __future__ import annotations

from pathweave.queries import answers, graph, texts


def queries() -> dict:
    return {**graph.QUERIES, **texts.QUERIES, **answers.QUERIES}


def oracle_sql() -> dict:
    return {**graph.SQL, **texts.SQL, **answers.SQL}
