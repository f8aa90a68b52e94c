"""Survey-microdata fusion and analysis on Spark DataFrames."""
