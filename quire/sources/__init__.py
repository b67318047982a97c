"""Inputs and sinks: derived tables, note files, written tables."""
