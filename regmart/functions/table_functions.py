"""The table-valued lookups as SQL functions, for use in the FROM clause.

    SELECT count(*) FROM include_list('7707049388', '', '')
    SELECT r.*, l.list_name FROM requests r, LATERAL include_list(r.inn, r.ogrn, r.kpp) l

The functions read the temporary views `counterparty_checks` and `include_lists`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..sources.schemas import SCHEMAS

_KEYS = ["inn", "ogrn", "kpp"]


def _lookup_by(i: int) -> str:
    """Entries for lookups whose first given key is number `i`. Each branch joins by an equality, so that a lateral call over a table of
    lookups can be planned as joins by key; keys not given are empty."""
    if i == len(_KEYS):
        # Lookups that give no key find every entry: on both sides nothing is left, as long as Spark does not see that it is so.
        return f"SELECT * FROM include_lists WHERE length({' || '.join(f'want_{k}' for k in _KEYS)}) = length(left(coalesce(list_name, ''), 0))"
    key = _KEYS[i]
    terms = [f"want_{key} = {key}", f"want_{key} <> ''", *(f"want_{k} = ''" for k in _KEYS[:i]), *(f"want_{k} IN ('', {k})" for k in _KEYS[i + 1 :])]
    return f"SELECT * FROM include_lists WHERE {' AND '.join(terms)}"


_BODIES = {
    # The second argument selects a calculation variant, which the stored checks have been made with already.
    "counterparty_check_by_inn": (
        "want_inn STRING, variant STRING",
        "counterparty_checks",
        "SELECT * FROM counterparty_checks WHERE inn = want_inn",
    ),
    "include_list": (
        "want_inn STRING, want_ogrn STRING, want_kpp STRING",
        "include_lists",
        " UNION ALL ".join(_lookup_by(i) for i in range(len(_KEYS) + 1)),
    ),
}


def register_table_functions(spark: SparkSession, names: Iterable[str] | None = None) -> list[str]:
    """Create the functions in the session, all or the named ones, whose views must be there; returns their names."""
    names = list(_BODIES if names is None else names)
    for name in names:
        arguments, view, body = _BODIES[name]
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({SCHEMAS[view]}) "
            f"RETURN {body}"
        )
    return names
