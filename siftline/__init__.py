"""Spark-native preparation, checking and loading of business records.

Every operator takes DataFrames (and small Python arguments such as a column
mapping) and returns a DataFrame or a Column, so that whole flows stay one
lazy Catalyst plan.
"""

__version__ = "0.1.0"
