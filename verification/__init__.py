"""Registered queries with their DuckDB counterparts, one module per topic."""

from verification import activity, cohorts, graphs, recordings, streams, traces

SUITES = [cohorts.SUITE, activity.SUITE, graphs.SUITE, traces.SUITE, recordings.SUITE, streams.SUITE]
