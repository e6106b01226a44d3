"""tallyframe: evaluation analytics as Spark DataFrame operators.

Every operator takes DataFrames and column names and returns a DataFrame.
"""

__version__ = "0.1.0"
