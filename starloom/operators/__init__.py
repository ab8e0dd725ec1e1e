"""Relational operators: aggregates, ordered groups, joins, fit/transform stages."""
