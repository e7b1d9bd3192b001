"""All registered queries of the engine."""

from . import boxes, evaluation, records, tables, trees  # noqa: F401
from . import registry

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
