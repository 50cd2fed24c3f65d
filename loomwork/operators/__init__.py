"""Operators: functions from DataFrames to DataFrames that know no particular table."""
