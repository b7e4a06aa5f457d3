"""Every registered query with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ci_scan, closed_scan, dependency_scan, evidence_scan, graph_scan, history_scan, library_scan, manifest_scan, operator_scan, project_scan, prose_scan, structure_scan, text_scan, toolchain_scan, tree_scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for module in (text_scan, history_scan, evidence_scan, closed_scan, dependency_scan, library_scan, ci_scan, manifest_scan, project_scan, graph_scan, tree_scan, structure_scan, operator_scan, prose_scan, toolchain_scan):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
