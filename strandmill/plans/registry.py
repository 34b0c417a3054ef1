"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from strandmill.plans import alignments, content, dedup, matching, sequences, streams, swarm, transfers

_MODULES = (dedup, sequences, alignments, swarm, content, matching, streams, transfers)


def queries():
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
