"""Sinks: views, tables, published report documents, run records, appends."""
