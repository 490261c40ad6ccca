"""Registered queries: library calls on the given tables, with their SQL twins."""

from catalog import registry
from catalog import (aggregates, analysis, audits, cleaning, dates, evaluation, joins, rolling,  # noqa: F401
                     runs, scans, tables)

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
