"""All registered queries of the candle library and their oracle SQL."""

from __future__ import annotations

from barloom.operators import audits, events, folds, indicators, joins, ledger_stats, levels, outcomes, resampling, setups, simulation, structure, validation
from barloom.plans import backtest, portfolio
from barloom.plans.sql import register
from barloom.sources import event_log, files
from barloom.streaming import candles as streaming
from barloom.streaming import carried, isolated

FLAGSHIP = "swings_4h"
QUERIES, ORACLES = {}, {}
for _module in (validation, indicators, structure, events, joins, ledger_stats, outcomes):
    _queries, _oracles = register(_module.SQL)
    QUERIES |= _queries
    ORACLES |= _oracles
for _module in (ledger_stats, folds, setups, simulation, backtest, portfolio, streaming, carried, audits, resampling, levels, outcomes, event_log, isolated, files):
    QUERIES |= _module.QUERIES
ORACLES |= streaming.ORACLES | carried.ORACLES | audits.ORACLES | resampling.ORACLES | levels.ORACLES | event_log.ORACLES | outcomes.ORACLES | isolated.ORACLES | files.ORACLES
