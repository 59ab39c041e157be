"""Literature analytics expressed as Spark DataFrames."""
