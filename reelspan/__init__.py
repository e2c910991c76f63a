"""Time-stamped transcript analytics on Spark DataFrames."""
