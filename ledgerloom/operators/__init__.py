"""Operators: functions from DataFrames to DataFrames; every threshold is an argument."""
