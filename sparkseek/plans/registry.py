"""All registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import analytics, corpus, engine, links, stored, streams, web

QUERIES = corpus.QUERIES | links.QUERIES | web.QUERIES | stored.QUERIES | engine.QUERIES | analytics.QUERIES | streams.QUERIES
ORACLES = corpus.ORACLES | links.ORACLES | web.ORACLES | stored.ORACLES | engine.ORACLES | analytics.ORACLES | streams.ORACLES
