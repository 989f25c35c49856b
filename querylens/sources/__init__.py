"""Readers and sinks: server logs, delimited exports, SQL dumps, look-back slices, tables."""
