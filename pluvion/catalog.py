"""Every query of the core by name, with its SQL where there is one."""

from pluvion.operators import faults, rolling, storms, units
from pluvion.plans import reference, series

_MODULES = [storms, rolling, units, faults, reference, series]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
