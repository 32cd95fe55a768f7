"""Every job and operator run on the test tables, each beside an independent SQL statement of the same result.

The register tables are not available, so each module shapes the test tables into the columns a job expects (orders
as deals, customers as realty and so on) and the SQL states the result directly, with plain joins, windows and distinct
aggregates.
"""

from . import adverts, contracts, deals, flags, objects, operators, reports, requests

_MODULES = [deals, reports, adverts, objects, contracts, flags, requests, operators]

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
