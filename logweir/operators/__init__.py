"""Operators: detection, parsing, filters, search, aggregation, correlation, sinks."""
