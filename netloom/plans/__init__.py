"""Whole analyses: the assignment driver, and queries with the SQL that says the same."""
