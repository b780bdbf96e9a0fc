"""Checking SQL: the same results recomputed from the raw tables, with line windows instead of whole-log
regexes, joins instead of in-row arrays."""
