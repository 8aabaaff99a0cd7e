"""Queries that need all terms ask for no expansion."""

from __future__ import annotations

from quarrylight.operators import retrieve as R


def test_requests_of_the_exact_leg_carry_no_groups(corpus):
    asked = R.as_asked(corpus.requests)
    lean = {r.ask.query_id: r.ask for r in R.asks(asked, expanded=False).collect()}
    whole = {r.ask.query_id: r.ask for r in R.asks(asked).collect()}
    assert R.asks(asked, expanded=False).schema["ask"].dataType.fieldNames() == R.asks(asked).schema["ask"].dataType.fieldNames()
    assert lean.keys() == whole.keys() and not any(a.groups for a in lean.values())
    assert all(a.exact == whole[q].exact and a.domain == whole[q].domain and a.days_per_week == whole[q].days_per_week for q, a in lean.items())
