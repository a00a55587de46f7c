"""Scans and sinks: CSV, landed pages, source registry, tables."""
