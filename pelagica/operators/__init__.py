"""Operators: cleaning, joins, sequences, summaries, geometry, calibration."""
