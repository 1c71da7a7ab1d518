"""All registered queries and their SQL."""

from __future__ import annotations

from tallymark.plans import corpus, events, fleet, reports, stores

QUERIES: dict = {**events.QUERIES, **fleet.QUERIES, **corpus.QUERIES, **reports.QUERIES, **stores.QUERIES}
ORACLES: dict = {**events.ORACLES, **fleet.ORACLES, **corpus.ORACLES, **reports.ORACLES, **stores.ORACLES}
