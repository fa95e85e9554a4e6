"""Forecasters, backtests, and the registered queries."""
