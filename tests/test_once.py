"""Costly steps of a query run once."""

from lexmill import plans
from lexmill.operators import critic as K

DIR = "/root/testdata/sf0.001"


def test_gaps_are_found_once(spark, monkeypatch):
    calls, real = [], K.missing_references
    monkeypatch.setattr(K, "missing_references", lambda *a: calls.append(1) or real(*a))
    for name in ("trace_evidence", "reader_report"):
        calls.clear()
        plans.QUERIES[name](spark, DIR)
        assert len(calls) == 1, name
