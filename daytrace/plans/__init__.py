"""Registered queries: an operator on its table, and the SQL that gives the same rows."""
