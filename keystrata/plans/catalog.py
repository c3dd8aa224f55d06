"""All queries of the core and their SQL."""

from __future__ import annotations

from keystrata.plans import base, commands, extra, folds, problems, store, streams, topology

MODULES = (store, folds, commands, topology, streams, extra, problems)
QUERIES = {**problems.QUERIES, **base.QUERIES}
SQL = {**problems.SQL, **base.SQL}
