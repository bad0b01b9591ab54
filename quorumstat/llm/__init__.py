"""Training-data operators on Spark DataFrames.  Nothing else in the package imports this one."""
