"""Equity factor research as Spark jobs on a long ``(date, ticker)`` panel."""
