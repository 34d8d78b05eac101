"""Vocarium: search and upkeep of time-stamped transcript archives on Spark."""
