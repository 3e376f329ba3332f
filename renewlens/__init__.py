"""Renewal decision intelligence as Spark jobs.

Every product is a function from DataFrames to a DataFrame and stays lazy:
it works on all customers or interactions at once and leaves the physical
strategy to Catalyst and adaptive execution.
"""
