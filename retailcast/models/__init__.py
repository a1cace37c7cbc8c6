"""Forecasters fitted as Spark jobs over all series at once."""
