"""All queries of the price side and their SQL."""

from . import account, bodies, catalog, discovery, extract, labels, linkage, queries, sites, streams, temporal  # noqa: F401  importing a module registers its queries
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
