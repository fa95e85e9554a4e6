"""quern: a PySpark engine for daily panels, calendar-aware forecasts and walk-forward scoring."""
