"""Relational operators: extraction, lookup, scoring, ranking, upsert, backtest."""
