"""All registered queries over the reference operators, and their SQL."""

from millrace.plans import item_oracles, item_queries, layout_oracles, layout_queries, oracles, queries

QUERIES = queries.QUERIES | layout_queries.QUERIES | item_queries.QUERIES
ORACLES = oracles.ORACLES | layout_oracles.ORACLES | item_oracles.ORACLES
