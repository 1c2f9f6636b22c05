"""Sinks: text, CSV, JSON lines, workbooks and documents."""
