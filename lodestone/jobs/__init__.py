"""Registered queries, by family."""

from lodestone.jobs import corpus, gates, graph, ledger, orders, points, strata, supervise
from lodestone.jobs.registry import Registry

JOBS = Registry()
for _family in (corpus, strata, points, graph, supervise, ledger, gates, orders):
    JOBS.queries |= _family.JOBS.queries
    JOBS.sql |= _family.JOBS.sql

flagship = corpus.survey_score
