"""All queries of the library and their SQL."""

from dealforge.plans import landed, matches, more, prices, relational, resolved, rules, stops, text

QUERIES, ORACLE = {}, {}
for module in (relational, text, prices, matches, more, rules, landed, resolved, stops):
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
