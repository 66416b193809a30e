"""Operators: functions from DataFrames to a DataFrame, for all users at once, with an explicit ``as_of``."""
