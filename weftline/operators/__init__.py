"""Operators: functions from DataFrames to a DataFrame, for use with DataFrame.transform or alone."""
