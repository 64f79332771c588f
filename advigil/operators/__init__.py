"""Operators: functions from DataFrames to DataFrames, planned by Catalyst."""
