"""Every registered query can be planned over the supplied tables."""

import pytest

from concord.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
#: These run jobs while they are planned and have tests of their own.
EAGER = ("replay_", "stream_", "identity_clusters", "table_", "reconcile_", "fullsync_", "operator_", "metric_replay", "event_", "ingest_", "audit_")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_query_is_planned(spark, name):
    assert QUERIES[name](spark, DATA).schema.fields


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)
