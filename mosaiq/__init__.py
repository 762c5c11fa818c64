"""mosaiq: collections of files as data, on Spark DataFrames."""
