"""Products: functions from DataFrames to a DataFrame."""
