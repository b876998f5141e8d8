"""Every registered query of the lap and telemetry operators, with its DuckDB SQL."""

from __future__ import annotations

from lapforge.plans import compare_queries, metric_queries, model_queries, quality_queries, race_queries, repair_queries, report_queries, spatial_queries, stream_queries, validation_queries, walk_queries

MODULES = [race_queries, repair_queries, metric_queries, compare_queries, model_queries, quality_queries, report_queries, spatial_queries, stream_queries, validation_queries, walk_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
