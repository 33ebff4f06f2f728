"""Joins, aggregates, rules and quality checks over chart and catalogue tables."""
