"""Registered queries over the driver's tables, with their SQL oracles."""

from creditmill.catalog import model_oracles, model_queries, oracles, queries

QUERIES = {**queries.QUERIES, **model_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **model_oracles.ORACLES}
#: Queries that SQL does not express; tests compare them with plain versions.
WITHOUT_ORACLE = model_oracles.WITHOUT
