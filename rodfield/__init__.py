"""Analytics over configurations of rods on Spark DataFrames."""
