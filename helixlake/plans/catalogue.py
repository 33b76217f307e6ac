"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from helixlake.plans import file_queries, vcf_queries
from helixlake.plans.queries import ORACLE_SQL, QUERIES

assert file_queries.QUERIES is QUERIES and vcf_queries.QUERIES is QUERIES  # they add their own
