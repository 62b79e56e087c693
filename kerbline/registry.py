"""Every registered query of the library with its SQL."""

from __future__ import annotations

from .plans import core, forecast, last, learned, live, rest

QUERIES: dict = {**core.QUERIES, **live.QUERIES, **rest.QUERIES, **last.QUERIES, **learned.QUERIES, **forecast.QUERIES}
ORACLES: dict = {**core.ORACLES, **live.ORACLES, **rest.ORACLES, **last.ORACLES, **learned.ORACLES, **forecast.ORACLES}
