"""All registered queries with their SQL twins."""

from . import catalogue, documents, pages  # noqa: F401  they register their queries
from .archive import ORACLE_SQL, QUERIES

FLAGSHIP = "parish_rollup"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
