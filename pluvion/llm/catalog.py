"""Every query of the subpackage by name, with its SQL where there is one."""

from pluvion.llm import cutoffs, digests, leaks, packing, residue

_MODULES = [cutoffs, digests, packing, leaks, residue]


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
