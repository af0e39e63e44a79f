"""Readers: recorded logs, message tables, stored mosaics."""
