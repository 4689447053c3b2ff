"""Rows from nothing: the demonstration table, random columns for tests and measurements, and fake values."""
