"""All queries over the driver's tables, and the SQL that says the same."""

from . import analysis, checks, evidence, graph, service

QUERIES = graph.QUERIES | evidence.QUERIES | analysis.QUERIES | service.QUERIES | checks.QUERIES
ORACLE_SQL = graph.ORACLE_SQL | evidence.ORACLE_SQL | analysis.ORACLE_SQL | service.ORACLE_SQL | checks.ORACLE_SQL
