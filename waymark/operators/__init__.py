"""Joins, scans and rankings of requests against the master table."""
