"""Queries over the audit fact table and its template dimension."""
