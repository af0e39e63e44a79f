"""Compositions of operators: the processing chain, reports, and the query catalogue."""
