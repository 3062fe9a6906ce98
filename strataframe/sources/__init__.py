"""Scans, sinks and schema mapping."""
