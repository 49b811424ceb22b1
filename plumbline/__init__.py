"""Spark-native modelling and reconciliation of public datasets.

Sources are read as text, typed column by column, joined to conformed
dimensions, published as marts and reconciled back to what was landed.
Every stage is a function from DataFrames to a DataFrame.
"""
