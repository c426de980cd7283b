"""Price-intelligence operators on Spark DataFrames."""
