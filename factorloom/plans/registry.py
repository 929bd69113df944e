"""All queries of the library and their SQL."""

from factorloom.plans import evaluation_queries, factor_queries, panel_queries, portfolio_queries

MODULES = [factor_queries, panel_queries, evaluation_queries, portfolio_queries]
FLAGSHIP = "e2_ic_summary"
QUERIES: dict = {}
SQL: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
