"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from tapeloom.plans import features, ledgers, live, stores

_ALL = {**features.QUERIES, **ledgers.QUERIES, **live.QUERIES, **stores.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _ALL.items() if s}
