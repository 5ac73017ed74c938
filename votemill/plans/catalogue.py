"""Every query of the core by name, with its SQL where SQL can express it."""

from __future__ import annotations

from votemill.plans import basics, flatten, histories, outcomes, panel, ratings

FLAGSHIP = "panel_category_agreement"
QUERIES = {**panel.QUERIES, **basics.QUERIES, **histories.QUERIES, **ratings.QUERIES, **flatten.QUERIES, **outcomes.QUERIES}
SQL = {**panel.SQL, **basics.SQL, **histories.SQL, **ratings.SQL, **flatten.SQL, **outcomes.SQL}
